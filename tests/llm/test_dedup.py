"""SimHash, line dedup and suffix-array dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import line_dedup as ld
from tessella.llm import simhash as sh
from tessella.llm import suffix_dedup as sd

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def fingerprint(text, n=3):
    w = words(text)
    grams = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def some_texts(rng, n):
    base = [" ".join(f"w{rng.integers(300)}" for _ in range(120)) for _ in range(n)]
    near = []
    for t in base[: n // 2]:
        w = t.split(" ")
        w[int(rng.integers(len(w)))] = "changed"
        near.append(" ".join(w))
    return base + near + base[:3]


def test_majority_handles_long_and_empty_lists():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 255, 256, 0, 700, 3]
    values = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = sh.majority(values.view(np.int64), offsets)
    for k, n in enumerate(sizes):
        part = [int(v) for v in values[offsets[k] : offsets[k + 1]]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in part) > n)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 20), st.integers(1, 200), st.integers(1, 300))
def test_bit_sliced_pairs(seed, radius, nq, nm):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**64, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 25), replace=False)) for _ in range(nq + nm)]
    fp = np.array([int(centre) ^ f for f in flips], np.uint64)
    q, m = fp[:nq], fp[nq:]
    a, b = sh.near_pairs(q, m, radius)
    want = {(i, j) for i in range(nq) for j in range(nm) if (int(q[i]) ^ int(m[j])).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


@pytest.mark.parametrize("group", [1e-9, 1e-5, 0.01, 1, 512])
def test_near_fingerprints_agree_in_a_mask(group):
    rng = np.random.default_rng(3)
    masks = sh.key_masks(1000, group)
    assert len(masks) in (1, 4, 10, 20)
    for _ in range(500):
        flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flip & m for m in masks)
        for m in masks:
            assert sum(sh.rest(m)) == (1 << 64) - 1 - m and not any(x & m for x in sh.rest(m))
            assert flip & m or any(not flip & x for x in sh.rest(m))


@pytest.mark.parametrize("chunk, group", [(4096, 512), (5, 512), (3, 1e-5)])
def test_components(frame, chunk, group, monkeypatch):
    monkeypatch.setattr(sh, "links", lambda nodes, *a, _f=sh.links, **k: _f(nodes, *a, **(k | {"chunk": chunk})))
    monkeypatch.setattr(sh, "key_masks", lambda n, _f=sh.key_masks: _f(n, group))
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(some_texts(rng, 40))] + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (None, "lonely words here now"), (0, "w1 w2")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(frame(rows)).collect()]
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = i if least.get(g) is None else (least[g] if i is None else min(i, least[g]))
    # A key on several rows joins what these rows belong to.
    want = sorted(str((i, f"{f:016x}", least[g])) for g, f, (i, _) in zip(group, fps, rows, strict=True))
    joined = sorted(map(str, got))
    assert [x for x in joined if not x.startswith("(0,")] == [x for x in want if not x.startswith("(0,")]


def test_similar_groups_and_first(frame):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(5000)}" for _ in range(200)) for _ in range(30)]
    rows = list(enumerate(base))
    for k in range(10):
        w = base[k].split(" ")
        w[20] = w[150] = "other"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, base[k]) for k in range(5)] + [(300, None), (301, "")]
    got = {r.doc_id: r.component_id for r in sh.similar_groups(frame(rows)).collect()}
    assert all(got[100 + k] == k for k in range(10)) and all(got[200 + k] == k for k in range(5)) and all(got[k] == k for k in range(30))
    assert got[301] == 300
    assert sorted(r.doc_id for r in sh.keep_first(frame(rows)).collect()) == [*range(30), 300]
    assert sh.near_duplicates(frame([])).count() == 0 and sh.keep_first(frame([])).count() == 0


def jaccard(x, y, n=5):
    a, b = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for w in map(words, (x, y)))
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("chunk", [1024, 4])
def test_every_pair_of_the_similarity_is_linked_and_no_other(frame, chunk, monkeypatch):
    """Copies with more and more changed words, two of each; groups by brute force."""
    monkeypatch.setattr(sh, "SET_CHUNK", chunk)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(50):
        base = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(60, 300)))]
        rows.append((1000 * k, " ".join(base)))
        for j in range(1, 8):
            w = list(base)
            for at in rng.choice(len(w), max(1, j * len(w) // 150), replace=False):
                w[at] = f"x{rng.integers(4000)}"
            # Repeated passages change no set of shingles by much, but a count of them.
            rows.append((1000 * k + j, " ".join(w + w[:20] * (j % 3))))
    group = list(range(len(rows)))
    alike = 0
    for i in range(len(rows)):
        for j in range(i - i % 8, i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                alike += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    assert 100 < alike < 1300
    low = {}
    for g, (i, _) in zip(group, rows):
        low[g] = min(low.get(g, i), i)
    got = {r.doc_id: r.component_id for r in sh.similar_groups(frame(rows)).collect()}
    assert got == {i: low[g] for g, (i, _) in zip(group, rows)}


def test_recall_by_similarity_on_the_given_documents(spark):
    """Of all pairs at 0.8 or more among the documents of sf0.01, all end in one group; no group holds others alone."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    shingles, holders = {}, {}
    for i, t in docs:
        w = words(t)
        shingles[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for x in shingles[i]:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for p, i in enumerate(ids):
            for j in ids[:p]:
                shared[j, i] = shared.get((j, i), 0) + 1
    pairs = [p for p, n in shared.items() if n >= 0.8 * (len(shingles[p[0]]) + len(shingles[p[1]]) - n)]
    got = {r.doc_id: r.component_id for r in sh.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(pairs) > 50 and all(got[a] == got[b] for a, b in pairs)
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    empty = [i for i, t in docs if not words(t)]
    assert all(got[i] == find(i) for i, _ in docs if i not in empty)


# ------------------------------------------------------------------ lines


def brute_lines(rows, chars=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    holders = {}
    for r, (_, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            if len(x) >= chars:
                holders.setdefault(x, []).append(r)
    low = -(2**63)
    ident = [low if i is None else i for i, _ in rows]
    out = []
    for r, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            h = holders.get(key(x), [])
            if len(h) >= docs and ident[r] != max(ident[k] for k in h):
                continue
            kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(frame):
    a, b, c = "This line is shared by many", "  another SHARED line of text\t", "É line with accents, long enough"
    rows = [(1, f"{a}\nown line of one, only here\n{b}"), (2, f"{a.upper()}\n{b.strip()}\n\nx"), (3, f"{a}\n{c}"), (4, f"{c}\n{c}\nshort"), (5, f"{c.upper()}"), (6, c), (7, None), (8, "")]
    rows += [(None, a), (3, f"{a}\n{c}"), (9, (a + "\n") * 500 + "end"), (10, "z" * 100_000)]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in ld.dedup_lines(frame(rows).drop("n_words")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))
    assert ld.dedup_lines(frame([])).count() == 0


@pytest.mark.parametrize("shard_keys", [65_536, 3])
def test_line_dedup_random_and_heavy(frame, shard_keys, monkeypatch):
    monkeypatch.setattr(ld, "CROWD", 1)
    monkeypatch.setattr(ld, "SHARD_LINES", 100)
    rng = np.random.default_rng(4)
    pool = [f"line number {k} of the pool of lines" for k in range(60)]
    rows = [(i, "\n".join([pool[0]] + [pool[int(k)] for k in rng.integers(1, 60, rng.integers(0, 9))])) for i in range(1300)]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in ld.dedup_lines(frame(rows).drop("n_words"), shard_keys=shard_keys).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))


def test_line_dedup_of_text_keys_and_clashing_names(spark):
    line = "A line that many documents hold"
    rows = [(k, f"{line}\nown {k}", "x", 7) for k in ("b", "a", "d", None, "c")]
    got = {r.name: (r.text, r.drops, r.n_lines, r.n_dropped) for r in ld.dedup_lines(spark.createDataFrame(rows, "name string, text string, drops string, n_lines int"), "name").collect()}
    assert got["d"] == (f"{line}\nown d", "x", 2, 0)
    assert all(got[k] == (f"own {k}", "x", 2, 1) for k in ("a", "b", "c", None))


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    mph = ld.MinimalPerfectHash.unpack(*ld.MinimalPerfectHash.build(*h).pack())
    assert sorted(mph.slots(*h).tolist()) == list(range(5000))
    index = ld.LineIndex.unpack(ld.LineIndex.build(*h, np.arange(5000), np.arange(5000) * 7).pack())
    count, last = index.probe(*h)
    assert count.tolist() == list(range(5000)) and last.tolist() == [7 * k for k in range(5000)]
    other = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    assert not index.probe(*other)[0].any()
    empty = ld.LineIndex.build(*h[:, :0], np.zeros(0), np.zeros(0))
    assert not empty.probe(*h)[0].any()


# ------------------------------------------------------------------ bytes


def brute_bytes(rows, span=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raws:
        for k in range(len(r) - span + 1):
            seen[r[k : k + span]] = seen.get(r[k : k + span], 0) + 1
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - span + 1):
            if seen[r[k : k + span]] > 1:
                gone[k : k + span] = True
        left = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def byte_rows(rng):
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(90), text(60) + " é ü " + text(30)
    rows = [(k, f"{text(30)} {shared[: int(rng.integers(150, len(shared)))]} {text(20)}") for k in range(24)]
    rows += [(100, other + other), (101, text(5) + other[3:]), (102, "a" * 1000), (103, "ab" * 300), (104, None), (105, ""), (106, text(20)), (106, text(40))]
    rows += [(107, shared), (108, shared), (109, shared[:199]), (110, shared[:200]), (None, shared[1:])]
    return rows


@pytest.mark.parametrize("bucket, shard", [(4096, 1024), (4, 2), (64, 5)])
def test_suffix_dedup(frame, bucket, shard):
    rows = byte_rows(np.random.default_rng(9))
    out = sd.remove_repeats(frame(rows).select("doc_id", "text"), bucket_regions=bucket, shard_regions=shard).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, brute_bytes(rows)))


def test_shards_are_merged_on_the_given_documents(spark):
    """Windows found in two shards, with the sizes of production; the outcome by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    solved = sd.solved_regions(rows, sd.shared_regions(rows))
    assert solved.filter("n = -1").agg(F.sum("h1")).first()[0] > 100
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup_query(docs).collect()]
    assert sorted(got) == sorted(brute_bytes([tuple(r) for r in docs.collect()]))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(1, 4))
def test_windows_are_found_by_binary_search(seed, alphabet, shards):
    rng = np.random.default_rng(seed)
    pool = [rng.integers(97, 97 + alphabet, int(rng.integers(200, 330)), dtype=np.uint8).tobytes() for _ in range(4)]
    regions = [pool[int(rng.integers(4))][int(rng.integers(0, 30)) :] for _ in range(9)] + [bytes(pool[0][:250]) + b"z" * 50]
    regions = [r if len(r) >= 200 else r + b"q" * (200 - len(r)) for r in regions]
    weights = rng.integers(1, 3, len(regions)).astype(float)
    region, start, _ = sd.repeated_starts(regions, weights, rng.integers(0, shards, len(regions)))
    held = {}
    for r, w in zip(regions, weights):
        for s in range(len(r) - 199):
            held[r[s : s + 200]] = held.get(r[s : s + 200], 0) + w
    want = [(k, s) for k, r in enumerate(regions) for s in range(len(r) - 199) if held[r[s : s + 200]] > 1]
    assert list(zip(region.tolist(), start.tolist())) == want


def test_suffix_dedup_names_that_clash(spark):
    out = sd.remove_repeats(spark.createDataFrame([(1, "x", "y", 3, 4)], "uid long, text string, kept string, n_bytes int, first int"))
    assert out.columns == ["uid", "first", "n_bytes", "n_removed", "n_spans", "kept"] and out.first().n_bytes == 1


def test_suffix_dedup_empty_and_extra_columns(frame):
    assert sd.remove_repeats(frame([])).count() == 0
    assert sd.remove_repeats(frame([(1, "x")])).columns == ["doc_id", "n_words", "fp", "n_bytes", "n_removed", "n_spans", "kept"]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.integers(1, 5), st.integers(1, 40))
def test_suffix_array_and_prefixes(raw, alphabet, lanes):
    data = np.frombuffer(bytes(b % alphabet + 97 for b in raw), np.uint8)
    sa = sd.suffix_array(data)
    text = data.tobytes()
    cut = [text[k : k + sd.DEPTH] for k in sa]
    assert sorted(sa.tolist()) == list(range(len(text)))
    # Beyond the end stand zeros, which no text here holds.
    assert cut == sorted(cut)
    lcp = sd.common_prefixes(data, sa, lanes)
    for k in range(1, len(sa)):
        x, y, n = cut[k - 1], cut[k], 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        assert lcp[k] == n
