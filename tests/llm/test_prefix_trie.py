"""The prefix trie against dictionaries of prefixes, and the radix tree by itself."""

import hashlib
import random
import zlib

import pytest

from tessella.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, key long, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], digest(p)) for p, m in members.items()]


def talks(n, seed, deep=6):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, deep])):
            said = rng.choice(["hello", "grüße", "", None, f"own {c} {t}", "the same turn"])
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), said))
    return rows


@pytest.fixture(params=[3, 10_000])
def batch(spark, request):
    """Runs of three keys, so that nearly all nodes are shared between runs, and of many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("chunk", [8, 1 << 16])
def test_trie_equals_dictionaries(spark, batch, chunk, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_CHARS", chunk)
    rows = talks(120, 1) + [(None, 0, "user", "no conversation")] + [(500 + 5 * k, 0, "user", "a very common talk") for k in range(60)]
    rows += [(900, t, "user", f"long {t % 7}") for t in range(300)] + [(905, t, "user", f"long {t % 7}") for t in range(299)]
    rows += [(1000, 1, "a", "twice")] * 2 + [(1005, 0, "1", "2:x"), (1010, 0, "12", ":x"), (7001, 3, "user", "its first is absent")]
    out = pt.prefix_trie(frame(spark, rows))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, brute(rows)))


def test_turnless_and_nothing(spark, batch):
    assert pt.prefix_trie(frame(spark, [])).count() == 0
    assert pt.prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    alone = next(c for c in range(10, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(alone, 0, "user", "goes, as the first h turns are another's")]
    got = [tuple(r) for r in pt.prefix_trie(frame(spark, rows)).collect()]
    assert got == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    more = rows + [(200, 0, "user", "hi"), (200, 1, None, None)]
    assert sorted(map(str, (tuple(r) for r in pt.prefix_trie(frame(spark, more)).collect()))) == sorted(map(str, brute(more)))


def test_layouts_grow_and_find_all():
    rng = random.Random(3)
    for fan in (4, 5, 16, 17, 48, 49, 256):
        tree, bytes_ = pt.Tree(), rng.sample(range(256), fan)
        for no, byte in enumerate(bytes_):
            tree.insert(bytes([9, 9, byte, 1]), no)
        layout = tree.root.layout.get(9).layout
        assert type(layout).__name__ == {4: "Node4", 5: "Node16", 16: "Node16", 17: "Node48", 48: "Node48", 49: "Node256", 256: "Node256"}[fan]
        assert [k.value for k in layout.children()] == [bytes_.index(b) for b in sorted(bytes_)]
        assert all(layout.get(b).value == no for no, b in enumerate(bytes_)) and tree.root.layout.get(8) is None


def test_nodes_only_at_turns():
    """Ids that part in their first, a middle and their last byte give one node a turn."""
    ids = [bytes([a]) + bytes(7) + bytes([m]) + bytes(6) + bytes([z]) for a in (0, 1) for m in (0, 5) for z in (0, 9)]
    keys = sorted(x + y for x in ids for y in ids[:3])
    rows = pt.run_nodes(keys, [1] * len(keys), list(range(len(keys))), [[2, 3]] * len(keys), [""] * len(keys))[:-1]
    assert sorted(r[3] for r in rows) == [0] + [1] * 8 + [2] * 24
    root = next(r for r in rows if r[3] == 0)
    assert root[5:9] == [24, 8, 24, 8 * 2 * 2]


def test_very_long_and_many(spark):
    """A talk of 20,000 turns, and a first turn that all share."""
    rows = [(1, t, "user", f"t{t}") for t in range(20_000)] + [(10 * c, t, "user", "common" if t == 0 else f"{c} {t}") for c in range(1, 3000) for t in (0, 1)]
    assert sorted(map(str, (tuple(r) for r in pt.prefix_trie(frame(spark, rows)).collect()))) == sorted(map(str, brute_long(rows)))


def brute_long(rows):
    """Prefixes by running digests, as tuples of 20,000 turns would be too many."""
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t, r, x))
    members, up, size, ends = {}, {}, {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = sorted(own.get(c - c % 5, []))[:h] + sorted(own[c])[h:]
        state, before = hashlib.sha256(), None
        for d in range(len(seq) + 1):
            if d:
                state.update(repr(seq[d - 1][1:]).encode())
            p = (d, state.hexdigest())
            members.setdefault(p, []).append(c)
            up[p], size[p], before = before, len(seq[d - 1][2].encode()) if d else 0, p
        ends.setdefault(before, []).append(c)
    kids, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in sorted(members, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * size[p]
        if up[p]:
            kids[up[p]] += 1
            leaves[up[p]] += leaves[p]
            saved[up[p]] += saved[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return [(min(m), p[0], min(members[up[p]]) if up[p] else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items()]
