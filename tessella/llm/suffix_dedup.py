"""Removal of repeated byte strings by suffix arrays over bounded shards.

A byte goes if a string of SPAN = 200 bytes that covers it starts at two places or more.

1. Every document hashes its K-grams and, by winnowing, gives each 200-byte window the
   anchor with the least hash in it. Equal windows have equal anchors, so windows whose
   anchor occurs once in the corpus are unique, and only the others go on. The windows of
   one anchor at one place are a stretch of starts; it and the bytes it covers make a region.
2. Equal regions of an anchor (by 128-bit hashes) are one, weighted by the number of its
   places and read at one of them.
3. All of them are dealt by anchor to buckets, and in a bucket by hash to shards of bounded
   size. A shard builds a suffix array (Larsson-Sadakane: ranks by 8 bytes, doubled for the
   groups that are still open until 200 bytes are told apart) and common prefixes by Kasai;
   runs of prefixes of 200 or more are its distinct windows, in order.
4. The shards of a bucket are merged by binary search: each distinct window of one is looked
   up among those of the others, and weights of equal ones are added. A window repeats if
   its weight is over 1.
5. An anchor with more regions than a bucket may hold is split over several buckets. Each
   sends the 128-bit hash of every distinct window once; their counts are summed by hash, and
   windows that do not repeat in their own bucket are joined to the repeated hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize

SPAN, K = 200, 48
#: Bytes that the suffix order tells apart: 8, doubled until they cover SPAN.
DEPTH = 256
#: Regions in a bucket on average and of one anchor at most, and in a shard; a region has under 600 bytes.
BUCKET_REGIONS, SHARD_REGIONS = 4096, 1024
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- anchors


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from every position that has them, from hashes of their halves."""
    z, size = _words8(data), 8
    while size < K:
        step = min(size, K - size)
        n = len(z) - step
        z = z[:n] * _M1 + (z[step:] ^ (z[:n] >> np.uint64(29))) * _M2
        z ^= z >> np.uint64(32)
        z *= _M1
        size += step
    return (z ^ (z >> np.uint64(29)))[: len(data) - K + 1]


def _window_minima(h: np.ndarray, run: int) -> np.ndarray:
    """Place of the least of every ``run`` consecutive values, the leftmost among equals.

    Prefix and suffix minima inside blocks of ``run``; a window meets two blocks at most.
    The choice depends on the window's own values alone, never on where it stands.
    """
    n = len(h)
    m = n - run + 1
    # The low bits hold the place in the block.
    mask = np.uint64((1 << (run - 1).bit_length()) - 1)
    low = (h & ~mask) | (np.arange(n) % run).astype(np.uint64)
    pad = -n % run
    full = np.concatenate([low, np.full(pad, ~np.uint64(0))]).reshape(-1, run)
    ahead = np.minimum.accumulate(full, axis=1).ravel()[run - 1 : run - 1 + m]
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    start = np.arange(m, dtype=np.int64)
    left = (behind & ~mask) <= (ahead & ~mask)
    block = np.where(left, start, start + run - 1) // run
    return block * run + (np.where(left, behind, ahead) & mask).astype(np.int64)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) per anchor: the window starts first..last are its own."""
    if len(data) < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = _gram_hashes(data)
    at = _window_minima(h, SPAN - K + 1)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([cut[1:], [len(at)]]) - 1
    return h[at[cut]].view(np.int64), cut, last


def _bytes(column: pa.Array, i: int) -> bytes:
    return column[i].as_buffer().to_pybytes() if column[i].is_valid else b""


_FOUND = {"uid": pa.int64(), "anchor": pa.int64(), "region": pa.int64(), "mark": pa.int64(), "first": pa.int32(), "last": pa.int32()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per anchor: the document, hashes of the anchor and of the region (128 bits), its starts."""
    for b in batches:
        ids, texts = b.column("uid").to_numpy(), b.column("text")
        for lo in range(0, len(ids), 512):
            out = []
            for i in range(lo, min(lo + 512, len(ids))):
                raw = _bytes(texts, i)
                h, first, last = anchors(np.frombuffer(raw, np.uint8))
                if not len(h):
                    continue
                view = memoryview(raw)
                digests = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(first.tolist(), (last + SPAN).tolist(), strict=True)])
                region, mark = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                out.append((np.full(len(h), ids[i], np.int64), h, region, mark, first, last))
            if out:
                arrays = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), _FOUND.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(_FOUND))


# ---------------------------------------------------------------- one shard


def suffix_array(data: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Places in the order of the ``depth`` or more bytes from them (Larsson-Sadakane).

    Groups of equal ranks are refined by the rank ``h`` further on, h doubling from 8; a
    place whose group has one member is never sorted again.
    """
    n = len(data)
    key = _words8(data)
    sa = np.argsort(key)
    sorted_ = key[sa]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    # A group's rank is the place of its first member in the array.
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        at = sa[open_]
        group = rank[at]
        further = rank[np.minimum(at + h, n)] + 1
        order = np.argsort(group * (n + 1) + further)
        at, group, further = at[order], group[order], further[order]
        sa[open_] = at
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])])
        new[open_] |= split
        rank[at] = np.maximum.accumulate(np.where(split, open_, 0))
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, lanes: int = 16_384) -> np.ndarray:
    """Common prefix, up to DEPTH, of each place in ``sa`` with the one before it (Kasai).

    In text order a place keeps at least the prefix of the place before it less one; after
    a prefix of DEPTH, which the order does not tell apart, it starts from nothing. The
    text is cut into lanes that run abreast, each by Kasai's rule, and prefixes grow by
    eight bytes at a time.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.concatenate([_words8(data), np.zeros(DEPTH + 8, np.uint64)])
    width = -(-n // min(lanes, n))
    heads = np.arange(0, n, width)
    prefix = np.zeros(len(heads), np.int64)
    plcp = np.zeros(n, np.int64)
    for step in range(width):
        at = heads + step
        at = at[at < n]
        other = before[at]
        held = prefix[: len(at)]
        known = np.where((other >= 0) & (held < DEPTH), np.maximum(held - 1, 0), 0)
        limit = np.minimum(DEPTH, n - np.maximum(at, other))
        live = np.flatnonzero((other >= 0) & (known < limit))
        while len(live):
            differ = words[at[live] + known[live]] ^ words[other[live] + known[live]]
            same = differ == 0
            # Equal leading bytes of the eight; none is odd where all are equal.
            lead = (differ.byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            lead[same] = 8
            known[live] = np.minimum(known[live] + lead, limit[live])
            live = live[same & (known[live] < limit[live])]
        prefix[: len(at)] = known
        plcp[at] = known
    out = plcp[sa]
    out[0] = 0
    return out


def _ordered(regions: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, start, group) of all windows of SPAN bytes in order; equal windows are one group."""
    sizes = np.array([len(r) for r in regions], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = np.frombuffer(b"".join(regions), np.uint8)
    sa = suffix_array(data)
    group = np.cumsum(common_prefixes(data, sa) < SPAN)
    region = np.repeat(np.arange(len(regions)), sizes)[sa]
    start = sa - base[region]
    # Places too near the end of a region have windows that cross into the next one.
    whole = start <= sizes[region] - SPAN
    return region[whole], start[whole], group[whole]


def located(words: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By binary search: where each wanted window stands in the ordered table, and whether it is there.

    Windows are given by their places in the text that ``words`` holds 8 bytes of from each
    place; the first 8 bytes narrow the search, which then compares all of them.
    """
    first, key = words[table], words[wanted]
    lo, hi = np.searchsorted(first, key, "left"), np.searchsorted(first, key, "right")
    there = np.zeros(len(wanted), bool)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        x, y = table[mid], wanted[open_]
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        left = np.arange(len(open_))
        for k in range(8, SPAN, 8):
            a, b = words[x[left] + k], words[y[left] + k]
            other = a != b
            at = left[other]
            same[at], less[at] = False, a[other] < b[other]
            left = left[~other]
            if not len(left):
                break
        there[open_[same]] = True
        lo[open_] = np.where(less, mid + 1, np.where(same, mid, lo[open_]))
        hi[open_] = np.where(less, hi[open_], mid)
        open_ = open_[~same & (lo[open_] < hi[open_])]
    return lo, there


def repeated_starts(regions: list[bytes], weights: np.ndarray, shard_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(region, start) of every window of SPAN bytes that repeats, weights counted, and the windows found in two shards.

    Each shard is ordered by itself; then its distinct windows are looked up among those of
    the shards before it, and put in their places there.
    """
    shard_of = np.zeros(len(regions), np.int64) if shard_of is None else shard_of
    sizes = np.array([len(r) for r in regions], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    words = _words8(np.frombuffer(b"".join(regions), np.uint8))
    table = kinds = np.zeros(0, np.int64)
    seen, met, n = [], 0, 0
    for k in np.unique(shard_of).tolist():
        mine = np.flatnonzero(shard_of == k)
        region, start, group = _ordered([regions[i] for i in mine.tolist()])
        if not len(region):
            continue
        region = mine[region]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        wanted = base[region[head]] + start[head]
        at, there = located(words, table, wanted)
        kind = np.empty(len(head), np.int64)
        kind[there] = kinds[at[there]]
        fresh = ~there
        kind[fresh] = n + np.arange(int(fresh.sum()))
        n += int(fresh.sum())
        met += int(there.sum())
        table, kinds = np.insert(table, at[fresh], wanted[fresh]), np.insert(kinds, at[fresh], kind[fresh])
        seen.append((region, start, kind[np.cumsum(np.diff(group, prepend=-1) != 0) - 1]))
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    region, start, kind = (np.concatenate(x) for x in zip(*seen, strict=True))
    again = np.bincount(kind, weights=weights[region], minlength=n)[kind] > 1
    region, start = region[again], start[again]
    order = np.lexsort((start, region))
    return region[order], start[order], met


def _runs(region: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one region as (region, first, last)."""
    if not len(region):
        return region, start, start
    cut = np.concatenate([[0], np.flatnonzero((np.diff(region) != 0) | (np.diff(start) != 1)) + 1])
    end = np.concatenate([cut[1:], [len(region)]]) - 1
    return region[cut], start[cut], start[end]


_SOLVED = {"anchor": pa.int64(), "region": pa.int64(), "mark": pa.int64(), "first": pa.int32(), "last": pa.int32(), "n": pa.int32(), "h1": pa.int64(), "h2": pa.int64()}


def solve_bucket(ids: np.ndarray, texts: list[bytes], weights: np.ndarray, split: np.ndarray, shard_regions: int = SHARD_REGIONS) -> list[np.ndarray]:
    """Columns of _SOLVED, ``ids`` being (anchor, region, mark) by region.

    n = 0 gives runs of repeats, n > 0 each distinct window of split anchors once: 1 where it
    stands once in the bucket, at ``first`` of the region, else 2. So a window of however
    many regions is one row of each bucket. n = -1 counts, in h1, windows found in two shards.
    """
    shards = max(2, -(-len(texts) // shard_regions))
    region, start, met = repeated_starts(texts, weights, (ids[2].view(np.uint64) % np.uint64(shards)).astype(np.int64))
    r, first, last = _runs(region, start)
    zero = np.zeros(len(r), np.int64)
    out = [(r, first, last, zero, zero, zero), tuple(np.array([x], np.int64) for x in (0, 0, 0, -1, met, 0))]
    if split.any():
        of, at, digests = [], [], []
        for k in np.flatnonzero(split).tolist():
            view = memoryview(texts[k])
            n = len(texts[k]) - SPAN + 1
            digests += [xxhash.xxh3_128_digest(view[s : s + SPAN]) for s in range(n)]
            of.append(np.full(n, k, np.int64))
            at.append(np.arange(n))
        of, at = np.concatenate(of), np.concatenate(at)
        again = np.isin(of << 32 | at, region << 32 | start)
        hashes, one = np.unique(np.array(digests, "V16"), return_index=True)
        h1, h2 = np.frombuffer(hashes.tobytes(), np.int64).reshape(-1, 2).T
        out.append((of[one], at[one], at[one], np.where(again[one], 2, 1), h1, h2))
    r, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
    return [*(x[r] for x in ids), *rest]


def _solving(shard_regions: int):
    """Sorted by bucket."""

    def told(held: list[dict]) -> Iterator[pa.RecordBatch]:
        ids = np.stack([np.concatenate([h[c] for h in held]) for c in ("anchor", "region", "mark")])
        weights, split = (np.concatenate([h[c] for h in held]) for c in ("places", "split"))
        columns = solve_bucket(ids, [x for h in held for x in h["bytes"]], weights.astype(np.float64), split.astype(bool), shard_regions)
        for lo in range(0, len(columns[0]), 65_536):
            arrays = [pa.array(c[lo : lo + 65_536]).cast(t) for c, t in zip(columns, _SOLVED.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(_SOLVED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            bucket = b.column("bucket").to_numpy()
            if not len(bucket):
                continue
            columns = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "region", "mark", "places", "split", "bytes")}
            cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if held and bucket[lo] != at:
                    yield from told(held)
                    held = []
                at = bucket[lo]
                held.append({c: v[lo:hi] for c, v in columns.items()})
        if held:
            yield from told(held)

    return run


# ---------------------------------------------------------------- the corpus


def _entries(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[list[int], list[np.ndarray]]:
    """Bounds of each row's entries, and the entries' fields."""
    bounds = lists.offsets.to_numpy()
    fields = [lists.values.field(n).to_numpy(zero_copy_only=False) for n in names]
    return bounds.tolist(), fields


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted regions of each document."""
    names = ("anchor", "region", "mark", "places", "rivals", "first", "last")
    for b in batches:
        texts = b.column("text")
        bounds, fields = _entries(b.column("wanted"), names)
        first, stop = fields[5].tolist(), (fields[6] + SPAN).tolist()
        lo = 0
        while lo < len(texts):
            hi = lo + 1
            while hi < len(texts) and bounds[hi] - bounds[lo] < 4096:
                hi += 1
            got = []
            for i in range(lo, hi):
                raw = _bytes(texts, i)
                got += [raw[first[k] : stop[k]] for k in range(bounds[i], bounds[i + 1])]
            part = slice(bounds[lo], bounds[hi])
            yield pa.RecordBatch.from_arrays([*(pa.array(f[part], pa.int64()) for f in fields[:5]), pa.array(got, pa.binary())], names=[*names[:5], "bytes"])
            lo = hi


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document, and how much went."""
    for b in batches:
        texts = b.column("text")
        runs = b.column("runs")
        bounds, (first, last) = _entries(runs, ("first", "last"))
        out = [[], [], [], []]
        for i in range(len(texts)):
            raw = _bytes(texts, i)
            if not runs[i].is_valid:
                removed, edges, left = 0, 0, raw
            else:
                gone = np.zeros(len(raw) + 1, np.int64)
                part = slice(bounds[i], bounds[i + 1])
                np.add.at(gone, first[part], 1)
                np.add.at(gone, last[part] + SPAN, -1)
                gone = np.cumsum(gone)[:-1] > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                removed, edges = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            for o, v in zip(out, (len(raw), removed, edges, left), strict=True):
                o.append(v)
        added = [pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        keep = [c for c in b.schema.names if c not in ("text", "runs")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *added], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])


_REGION = ["anchor", "region", "mark"]


def _across(windows: DataFrame) -> DataFrame:
    """Runs of windows that stand once in their own bucket and again in another.

    Sums of a hash meet before the shuffle, and only windows that their bucket holds once
    ask for them, so a hash has no more rows than there are buckets.
    """
    again = windows.groupBy("h1", "h2").agg(F.sum("n").alias("all")).filter("all > 1").select("h1", "h2")
    again = materialize(again, "again")
    single = windows.filter("n = 1").select("h1", "h2", *_REGION, "first").join(again, ["h1", "h2"], "left_semi")
    starts = single.groupBy(*_REGION).agg(F.sort_array(F.collect_list("first")).alias("s"))
    first = F.expr("filter(s, (x, i) -> i = 0 or s[i - 1] < x - 1)")
    last = F.expr("filter(s, (x, i) -> i = size(s) - 1 or s[i + 1] > x + 1)")
    return starts.select(*_REGION, F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("r")).select(*_REGION, "r.first", "r.last")


def shared_regions(rows: DataFrame) -> DataFrame:
    """(uid, anchor, region, mark, first, last) of every anchor with two places or more, from (uid, text binary)."""
    found = rows.select("uid", "text").mapInArrow(_scan, "uid long, anchor long, region long, mark long, first int, last int")
    found = materialize(found, "anchors")
    per = found.groupBy("anchor").agg(F.count("*").alias("places"))
    # Written first, so that both sides of the join are plain shuffles and a hot anchor's
    # rows can be split between tasks.
    per = materialize(per.filter("places > 1").select("anchor"), "per")
    return materialize(found.join(per, "anchor"), "shared")


def solved_regions(rows: DataFrame, shared: DataFrame, bucket_regions: int = BUCKET_REGIONS, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """Rows of _SOLVED for the distinct regions of ``shared``, whose bytes ``rows`` has."""
    spark = rows.sparkSession
    # A region stands for all its places, and is read at one of them.
    distinct = materialize(shared.groupBy(*_REGION).agg(F.count("*").alias("places"), F.min(F.struct("uid", "first", "last")).alias("at")), "regions")
    rivals = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("rivals")), "rivals")
    wanted = distinct.join(rivals, "anchor").select("at.uid", F.struct(*_REGION, "places", "rivals", "at.first", "at.last").alias("w"))
    wanted = wanted.groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    regions = rows.select("uid", "text").join(wanted, "uid").select("text", "wanted").mapInArrow(_cut, "anchor long, region long, mark long, places long, rivals long, bytes binary")
    n = distinct.count()
    buckets = max(-(-n // bucket_regions), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    split = F.col("rivals") > bucket_regions
    own = F.pmod(F.xxhash64("anchor"), F.lit(buckets))
    sub = F.pmod(F.xxhash64("region"), F.ceil(F.col("rivals") / bucket_regions))
    bucket = F.when(split, F.pmod(F.xxhash64("anchor", sub), F.lit(2**61)) + buckets).otherwise(own)
    dealt = regions.select(*_REGION, "places", "bytes", split.alias("split"), bucket.alias("bucket"))
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(_solving(shard_regions), "anchor long, region long, mark long, first int, last int, n int, h1 long, h2 long"), "solved")


def repeated_runs(rows: DataFrame, bucket_regions: int = BUCKET_REGIONS, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """(uid, first, last): runs of starts of repeated windows, from (uid, text binary) with distinct uid."""
    shared = shared_regions(rows)
    solved = solved_regions(rows, shared, bucket_regions, shard_regions)
    repeats = solved.filter("n = 0").select(*_REGION, "first", "last").unionByName(_across(solved.filter("n > 0")))
    within = repeats.groupBy(*_REGION).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    # Written first, as above: one region may stand in a third of all documents.
    within = materialize(within, "within")
    back = shared.select(*_REGION, "uid", F.col("first").alias("base")).join(within, _REGION)
    back = back.select("uid", "base", F.explode("runs").alias("r"))
    return back.select("uid", *[(F.col("base") + F.col(f"r.{c}")).cast("int").alias(c) for c in ("first", "last")])


def remove_repeats(docs: DataFrame, text: str = "text", bucket_regions: int = BUCKET_REGIONS, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_removed, n_spans and ``kept`` (bytes left).

    A null text is empty. Each row is a document of its own whatever its key, so a repeated
    row repeats all its windows; texts under SPAN bytes stay whole. Columns of ``docs`` that
    have a name of the added ones are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # Rows are known by a number that is written with them, so copies are rows of their own.
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    runs = repeated_runs(rows, bucket_regions, shard_regions)
    runs = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = rows.join(runs, "uid", "left").drop("uid")
    keys = ", ".join(f"k{i} {dict(rows.dtypes)[f'k{i}']}" for i in range(len(others)))
    out = joined.mapInArrow(_strip, f"{keys}{', ' if keys else ''}n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(others)})


def suffix_dedup_query(documents: DataFrame) -> DataFrame:
    out = remove_repeats(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
