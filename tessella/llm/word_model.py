"""Cross-entropy difference of two word bigram models over one vocabulary.

The vocabulary is every token of the corpus: runs of letters, digits and bytes from 0x80
on, A-Z lowered, and every other visible ASCII character by itself; ideographs and kana
are tokens one by one. Tokens and pairs are told apart by 63-bit hashes.

1. Rows are dealt to blocks of about BLOCK bytes. A task sends the distinct tokens and
   pairs of each block once, with their counts in it, cut by range of the hash: a word of
   every document is one entry a block, so no range is hot.
2. A range's task adds these up over the whole corpus and answers every block with the sums
   in the order of its hashes, which need not be sent back.
3. The answers meet their block's texts, and each text's loss is summed over its tokens.

Every text is scored by what the others hold: its own counts are taken out of each model
that has counted it, so a text that stands alone has no part in its own loss, and one that
occurs twice is known by its copy. Nothing of the model passes through the driver but three
totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.plans.materialize import materialize

#: Bytes of text in a block (a longer text is a block of its own), and per range of hashes: at
#: least and at most, by what a task can hold. In between both grow with the root of the corpus,
#: so that there is one row of entries, for a block and a range, for ROW bytes of text.
BLOCK, RANGE, ROW = 1 << 22, 1 << 23, 1 << 14
BLOCK_MOST, RANGE_MOST = 1 << 25, 1 << 25
#: Bytes that are cut into tokens at once, by whole texts.
SLICE = 1 << 18
#: Weight of a context's own counts against the next lower order: n / (n + RESERVE).
RESERVE = 8.0
_U = np.uint64
_M = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(6).integers(0, 2**64, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
#: 0 blank or control, 1 part of a word, 2 a token of its own.
_KIND = np.array([0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
#: The end of a text, a token that is predicted like any other, and the context of its first.
END = _U(0x5851F42D4C957F2D)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.full(n, x, np.uint64)) for x in (_M, pow(_M, -1, 2**64))]
    return [p[:n] for p in _POWERS]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    z = (z ^ (z >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return z ^ (z >> _U(33))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, tokens per text) of texts that stand one behind the other; offsets from 0."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    kind = _KIND[data]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != 1) | (kind[:-1] != 1)
    wide = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    start[wide] = True
    start[np.minimum(wide + 3, n - 1)[wide + 3 < n]] = True
    start[offsets[:-1][offsets[:-1] < n]] = True
    stops = np.flatnonzero(start)
    ends = np.append(stops[1:], n)
    held = kind[stops] > 0
    starts, ends = stops[held], ends[held]
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * up, out=sums[1:])
    h = _mix((sums[ends] - sums[starts]) * down[starts]) | _U(1)
    return h, np.diff(np.searchsorted(starts, offsets))


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, pairs, tokens per text): every text with a token ends in END; pairs end in its tokens."""
    parts, lo = [tokens(data[:0], offsets[:1])], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        parts.append(tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        lo = hi
    h, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    full = sizes > 0
    at = np.arange(len(h)) + np.repeat(np.cumsum(full) - full, sizes)
    seq = np.full(len(h) + int(full.sum()), END, np.uint64)
    seq[at] = h
    before = np.concatenate([[END], seq[:-1]]).astype(np.uint64) if len(seq) else seq
    return seq, _mix(before * _U(_M) + (seq ^ (before >> _U(29)))) & ~_U(1), sizes


def _pack(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers: what is mostly zeros then compresses to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _data(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _dealing(most: int):
    """Adds the block of each row, and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, filled = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            sizes = b.column("n").to_numpy()
            out = np.zeros((2, len(sizes)), np.int64)
            for i, n in enumerate(sizes.tolist()):
                if place and filled + n > most:
                    block, place, filled = block + 1, 0, 0
                out[:, i] = block, place
                place, filled = place + 1, filled + n
            keep = [c for c in b.schema.names if c != "n"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, out)], names=[*keep, "block", "place"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, dict[str, list]]]:
    """Consecutive rows of one block."""
    held, at = {c: [] for c in columns}, None
    for b in batches:
        block = b.column("block").to_numpy()
        if not len(block):
            continue
        cuts = (np.flatnonzero(np.diff(block)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if at is not None and block[lo] != at:
                yield at, held
                held = {c: [] for c in columns}
            at = int(block[lo])
            for c in columns:
                held[c].extend(b.column(c).slice(lo, hi - lo).to_pylist())
    if at is not None:
        yield at, held


def _counting(parts: int):
    """Per block and range: steps of the sorted distinct hashes, and their counts in it, all and of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, ("text", "target")):
            seq, pairs, sizes = sequence(*_data(held["text"]))
            if not len(seq):
                continue
            chosen = np.repeat(np.array(held["target"], bool), sizes + (sizes > 0))
            hashes, which = np.unique(np.concatenate([seq, pairs]), return_inverse=True)
            every = np.bincount(which, minlength=len(hashes)).astype(np.uint32)
            target = np.bincount(which[np.tile(chosen, 2)], minlength=len(hashes)).astype(np.uint32)
            part = ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            spans = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
            for lo in range(0, len(spans), 1024):
                some = spans[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[[a for a, _ in some]], pa.int32()), pa.array([block] * len(some), pa.int64()),
                        pa.array([_pack(np.diff(hashes[a:b], prepend=_U(0))) for a, b in some], pa.binary()),
                        *(pa.array([_pack(x[a:b]) for a, b in some], pa.binary()) for x in (every, target)),
                    ],
                    names=["part", "block", "hashes", "every", "target"],
                )

    return run


_SUMS = "part int, block long, vocabulary long, n_every long, n_target long, counts binary"


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by range and block: sums over the corpus for each block; a null block has the totals."""

    def told(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([np.cumsum(_unpack(r[1], np.uint64), dtype=np.uint64) for r in rows])
        ends = np.cumsum([len(r[1]) // 8 for r in rows])
        whole, which = np.unique(hashes, return_inverse=True)
        # Sums stay whole numbers: doubles hold them up to 2**53.
        sums = [np.bincount(which, weights=np.concatenate([_unpack(r[k], np.uint32) for r in rows]), minlength=len(whole)).astype(np.int64) for k in (2, 3)]
        single = (whole & _U(1)).astype(bool)
        out = [(part, None, int(single.sum()), int(sums[0][single].sum()), int(sums[1][single].sum()), None)]
        lo = 0
        for k, (block, *_) in enumerate(rows):
            # A block that stands in two splits has sent its entries in two rows.
            if k + 1 < len(rows) and rows[k + 1][0] == block:
                continue
            mine = which[lo : ends[k]] if k == 0 or rows[k - 1][0] != block else np.unique(which[lo : ends[k]])
            out.append((part, block, None, None, None, b"".join(_pack(s[mine]) for s in sums)))
            lo = ends[k]
        kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary())
        names = ["part", "block", "vocabulary", "n_every", "n_target", "counts"]
        for lo in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 1024], strict=True), kinds, strict=True)], names=names)

    rows, at = [], None
    for b in batches:
        for part, *row in zip(*(b.column(c).to_pylist() for c in ("part", "block", "hashes", "every", "target")), strict=True):
            if rows and part != at:
                yield from told(at, rows)
                rows = []
            at = part
            rows.append(tuple(row))
    if rows:
        yield from told(at, rows)


def _own(seq: np.ndarray, pair: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Times that each token, and each pair, stands in its own text; ``which`` text each is in."""
    out = []
    for x in (seq, pair):
        _, back, times = np.unique(which * n + x, return_inverse=True, return_counts=True)
        out.append(times[back])
    return out[0], out[1]


def _loss(counts: np.ndarray, token: np.ndarray, pair: np.ndarray, end: int, starts: np.ndarray, own: tuple[np.ndarray, np.ndarray], used: np.ndarray, sizes: np.ndarray, vocabulary: int, total: int) -> np.ndarray:
    """-ln P of every token after the one before it, by interpolation with single tokens.

    ``used`` marks the texts that the model has counted: what they hold themselves is taken
    off. A text's first token has END before it, which the text holds once.
    """
    mine = np.repeat(used, sizes)
    one = counts[token] - own[0] * mine
    before = np.concatenate([[0], one[:-1]])
    before[starts] = counts[end] - used
    p1 = (one + 1) / (total - np.repeat(used * sizes, sizes) + vocabulary)
    return -np.log((counts[pair] - own[1] * mine + RESERVE * p1) / (before + RESERVE))


def _scoring(kind: pa.DataType, vocabulary: int, totals: tuple[int, int]):
    """Sorted by block, texts by place and then answers by range: the mean losses of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _blocks(batches, ("doc", "text", "target", "counts")):
            docs = [d for d, t in zip(held["doc"], held["text"], strict=True) if t is not None]
            chosen = np.array([c for c, t in zip(held["target"], held["text"], strict=True) if t is not None], bool)
            texts = [t for t in held["text"] if t is not None]
            answers = [np.stack([_unpack(x, np.int64) for x in (c[: len(c) // 2], c[len(c) // 2 :])]) for c in held["counts"] if c is not None]
            seq, pairs, sizes = sequence(*_data(texts))
            out = np.zeros((2, len(texts)))
            full = np.flatnonzero(sizes)
            if len(full):
                hashes, which = np.unique(np.concatenate([seq, pairs]), return_inverse=True)
                counts = np.concatenate(answers, axis=1)
                if counts.shape[1] != len(hashes):
                    raise RuntimeError("a block's answers do not fit its texts")
                lengths = sizes[full] + 1
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                token, pair = which[: len(seq)], which[len(seq) :]
                own = _own(token, pair, np.repeat(np.arange(len(full)), lengths), len(hashes))
                end = int(np.searchsorted(hashes, END))
                # The target's counts stand behind those of all.
                for k, model in enumerate((1, 0)):
                    used = chosen[full].astype(np.int64) if model else np.ones(len(full), np.int64)
                    loss = _loss(counts[model], token, pair, end, starts, own, used, lengths, vocabulary, totals[model])
                    out[k, full] = np.add.reduceat(loss, starts) / lengths
            yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(sizes), *map(pa.array, out)], names=["doc", "n_tokens", "target_loss", "background_loss"])

    return run


def layout(size: int, slots: int) -> tuple[int, int]:
    """(dealt blocks that make one, ranges) for a corpus of ``size`` bytes."""
    block = min(max(BLOCK, math.isqrt(size * ROW // 2)), max(BLOCK_MOST, BLOCK))
    span = min(max(RANGE, math.isqrt(size * ROW * 2)), max(RANGE_MOST, RANGE))
    return max(1, block // BLOCK), max(slots, -(-size // span))


def _entries(dealt: DataFrame, parts: int) -> DataFrame:
    return dealt.select("text", "target", "block").mapInArrow(_counting(parts), "part int, block long, hashes binary, every binary, target binary")


def score(docs: DataFrame, target: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, score) for every row.

    ``target`` marks the in-domain rows; null is no. A null or empty text has no tokens and
    all three figures 0; the means of the others are over their tokens and their end. The
    background is all rows, and so is the vocabulary of both models. Repeated rows count as
    often as they occur; each is scored by all rows but itself. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(key)).schema[0].dataType
    marked = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    dealt = marked.withColumn("n", F.length("text").cast("long")).mapInArrow(_dealing(BLOCK), f"doc {kind.simpleString()}, text binary, target boolean, block long, place long")
    dealt = materialize(dealt, "dealt")
    size = dealt.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    joined, parts = layout(size, slots)
    # Neighbours in one split; what they hold stays in order.
    low = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    dealt = dealt.withColumns({"block": F.col("block") - low + F.floor(low / joined), "place": F.shiftleft(low % joined, 32) + F.col("place")})
    entries = _entries(dealt, parts)
    entries = entries.repartition(parts, "part").sortWithinPartitions("part", "block")
    sums = materialize(entries.mapInArrow(_adding, _SUMS), "sums")
    totals = sums.filter("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "n_every", "n_target")]).first()
    texts = dealt.select("block", F.lit(-1).alias("part"), "place", "doc", "text", "target", F.lit(None).cast("binary").alias("counts"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc", kind), ("text", "binary"), ("target", "boolean"))]
    answers = sums.filter("block is not null").select("block", "part", F.lit(0).cast("long").alias("place"), *nothing, "counts")
    met = texts.unionByName(answers).repartition(parts, "block").sortWithinPartitions("block", "part", "place").select("block", "doc", "text", "target", "counts")
    scored = met.mapInArrow(_scoring(to_arrow_type(kind), totals[0], (totals[1], totals[2])), f"doc {kind.simpleString()}, n_tokens long, target_loss double, background_loss double")
    difference = F.round(F.col("target_loss") - F.col("background_loss"), 6)
    return scored.select(F.col("doc").alias(key), "n_tokens", F.round("target_loss", 6).alias("target_loss"), F.round("background_loss", 6).alias("background_loss"), difference.alias("score"))
