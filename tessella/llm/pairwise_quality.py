"""Quality scores by Bradley-Terry ranking of preference pairs.

Every labelled good document is preferred to every labelled bad one, and a good one of some
length to corruptions of itself (its words shuffled, its letters drawn anew), which no label
names. Weights are learnt from such pairs by logistic loss on the difference of their
features, and a quantile of the scores, the share of bad ones, is the threshold. Features
are counts of the whole text and hashed frequencies of its words, pairs of words, four-byte
strings and triples of letter classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.features import COUNTS, text_counts
from tessella.llm.sample import bounded
from tessella.llm.text import whole
from tessella.llm.word_model import sequence
from tessella.plans.materialize import materialize

#: Labelled rows to fit on, and preference pairs drawn from them: the documented bounds.
MAX_LABELLED, PAIRS, SEED, RIDGE, STEPS = 6_000, 60_000, 7, 3e-3, 300
#: Of the good ones, those of CORRUPT_WORDS words or more are corrupted, one in CORRUPT_EVERY.
CORRUPT_WORDS, CORRUPT_EVERY = 40, 3
#: Hashed frequencies: words, pairs of words, four bytes, triples of ten classes of bytes.
WORD_DIM, PAIR_DIM, GRAM_DIM, CLASSES = 256, 512, 512, 10
#: Figures that ``counted`` makes.
COUNTED = 14
HASHED = WORD_DIM + PAIR_DIM + GRAM_DIM + CLASSES**3
#: Parts in which the features reach the fit, one after the other.
FIT_PARTS = 32
#: Bytes of text whose features are computed at once, by whole texts.
SLICE = 1 << 19


def _class_table() -> np.ndarray:
    """Small vowels, other small letters, capitals, digits, blanks, line ends, full stops, other points, symbols, the rest."""
    table = np.full(256, 9, np.int32)
    groups = ("aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".!?", ",;:-()'\"/", "#*$%&|<>@=+~^_{}[]\\`")
    for k, group in enumerate(groups):
        for c in group:
            table[ord(c)] = k
    return table


_CLASS = _class_table()


def counted() -> list[Column]:
    """Numbers of a document from its counts; a text without words gives zeros but the last."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    n, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    letters, n_lines = F.greatest(c["n_letters"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))

    def steep(share: Column) -> Column:
        return F.log1p(100 * share)

    return [
        steep(c["n_symbols"] / chars),
        F.least(c["n_symbols"] / chars, F.lit(0.1)),
        steep(c["n_upper"] / letters),
        F.least(c["n_upper"] / letters, F.lit(0.5)),
        steep(c["n_repeat_words"] / n),
        F.least(c["n_repeat_words"] / n, F.lit(0.3)),
        c["n_dup_lines"] / n_lines,
        c["n_distinct"] / n,
        F.log1p(c["n_words"]),
        F.abs(c["word_chars"] / n - 5.5),
        c["n_letters"] / chars,
        c["n_broken"] / F.greatest(c["n_ends"], F.lit(1.0)),
        c["n_vowels"] / F.greatest(c["n_latin"], F.lit(1.0)),
        F.when(c["n_words"] == 0, 1.0).otherwise(0.0),
    ]


def hashed(texts: list[bytes]) -> np.ndarray:
    """(texts, HASHED) roots of frequencies; an empty text has only zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    seq, pairs, n = sequence(data, offsets)
    ends = np.where(n > 0, n + 1, 0)
    of = np.repeat(np.arange(len(texts)), ends)

    def table(rows: np.ndarray, bucket: np.ndarray, dim: int) -> np.ndarray:
        out = np.bincount(rows * dim + bucket, minlength=len(texts) * dim).reshape(len(texts), dim)
        return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)

    parts = [table(of, (x >> np.uint64(33)).astype(np.int64) % d, d) for x, d in ((seq, WORD_DIM), (pairs, PAIR_DIM))]
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    four = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32)
    for k in range(4):
        four[: len(data) - k] |= wide[k:] << np.uint32(8 * k)
    at = np.flatnonzero(left >= 4)
    parts.append(table(row[at], ((four[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % GRAM_DIM, GRAM_DIM))
    c = _CLASS[data]
    at = np.flatnonzero(left >= 3)
    parts.append(table(row[at], (c[at] * CLASSES + c[at + 1]) * CLASSES + c[at + 2], CLASSES**3))
    return np.concatenate(parts, axis=1)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    weight: np.ndarray
    threshold: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, one half at the threshold."""
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) @ self.weight - self.threshold) / self.scale, -40, 40)))


def weights(z: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Least mean of log(1 + exp(-(z[better] - z[worse]) w)) + ridge / 2 |w|^2, by L-BFGS.

    Differences are never formed: a pair's residual is added to its two documents.
    """
    n, d = z.shape

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = (z @ w.astype(z.dtype)).astype(np.float64)
        margin = s[better] - s[worse]
        r = 1 / (1 + np.exp(np.clip(margin, -40, 40))) / len(better)
        per = np.bincount(worse, r, n) - np.bincount(better, r, n)
        return float(np.logaddexp(0, -margin).mean() + ridge / 2 * w @ w), (per.astype(z.dtype) @ z).astype(np.float64) + ridge * w

    w = np.zeros(d)
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < 1e-7:
            break
        q, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += (a - y @ q / (s @ y)) * s
        step = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        while step > 1e-12:
            new, slope = loss(w - step * q)
            if new <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, y = -step * q, slope - g
        if s @ y > 1e-16:
            past = [*past[-9:], (s, y)]
        w, value, g = w + s, new, slope
    return w


def fit(x: np.ndarray, good: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None, n_counted: int | None = None, pairs: int = PAIRS, seed: int = SEED) -> Ranker:
    """Weights from ``pairs`` drawn pairs, and the threshold.

    ``more`` has pairs of rows, better and worse, that count a third as much again. Columns
    from ``n_counted`` on are frequencies, whose spread is not taken below the usual one.
    With only one class, or no rows, nothing can be learnt: all weights and the threshold
    are 0 and every score one half.
    """
    pos, neg = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(pos) or not len(neg):
        return Ranker(np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 1.0)
    mean = x.mean(axis=0)
    z = x - mean
    # Not x.std(), which makes two more arrays of the size of x.
    spread = np.sqrt(np.einsum("ij,ij->j", z, z) / len(z))
    if n_counted is not None and n_counted < x.shape[1]:
        spread[n_counted:] = np.maximum(spread[n_counted:], spread[n_counted:].mean()) * np.sqrt((x.shape[1] - n_counted) / n_counted)
    spread = np.where(spread > 1e-12, spread, 1.0)
    z /= spread
    rng = np.random.default_rng(seed)
    # A corruption is one of the bad, but stands in pairs with its own text only.
    own = np.setdiff1d(neg, more[1]) if more is not None and len(more[1]) else neg
    better, worse = rng.choice(pos, pairs), rng.choice(own if len(own) else neg, pairs)
    if more is not None and len(more[0]):
        at = rng.integers(0, len(more[0]), pairs // 3)
        better, worse = np.concatenate([better, more[0][at]]), np.concatenate([worse, more[1][at]])
    w = weights(z, better, worse)
    s = np.sort(z @ w)
    # Halfway between the scores on either side of the quantile.
    k = min(max(len(neg), 1), len(s) - 1)
    return Ranker(mean, w / spread, float((s[k - 1] + s[k]) / 2), float(max(s.std() / 4, 1e-9)))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def corruptions(text: str, seed: int) -> list[str]:
    """The words shuffled; every plain letter drawn anew from the consonants."""
    rng = np.random.default_rng(seed)
    words = text.split()
    data = np.frombuffer(text.encode(), np.uint8).copy()
    small, large = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    drawn = np.frombuffer(b"bcdfghjklmnpqrstvwxz", np.uint8)[rng.integers(0, 20, len(data))]
    data[small], data[large] = drawn[small], drawn[large] - 32
    return [" ".join(words[k] for k in rng.permutation(len(words))), data.tobytes().decode()]


def _corrupt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seeds, texts = b.column("h").to_pylist(), b.column("text").to_pylist()
        rows = [(h, 2 + k, t) for h, text in zip(seeds, texts, strict=True) if len(text.split()) >= CORRUPT_WORDS for k, t in enumerate(corruptions(text, h & 0xFFFFFFFF))]
        h, label, text = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(label, pa.int32()), pa.array(text, pa.string())], names=["h", "label", "text"])


def _batched(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, features) of rows with ``raw`` and ``counted``, some at a time."""
    raw, counts = batch.column("raw"), batch.column("counted")
    dense = counts.values.to_numpy()[counts.offsets[0].as_py() :].reshape(-1, COUNTED)
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in raw])
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, "right")))
        hi = min(hi, lo + 512, len(raw))
        x = hashed([x.as_buffer().to_pybytes() for x in raw.slice(lo, hi - lo)])
        yield lo, hi, np.concatenate([dense[lo:hi].astype(np.float32), x], axis=1)
        lo = hi


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, x in _batched(b):
            yield pa.RecordBatch.from_arrays([b.column("h").slice(lo, hi - lo), b.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "label", "x"])


def _stacked(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, label, x) of the first ``most`` rows, read a partition at a time into one buffer of float32."""
    out, h, kind = np.empty((min(rows.count(), most), COUNTED + HASHED), np.float32), [], []
    for r in rows.toLocalIterator():
        if len(h) == len(out):
            break
        out[len(h)] = np.frombuffer(r["x"], np.float32)
        h.append(r["h"])
        kind.append(r["label"])
    return np.array(h, np.int64), np.array(kind, np.int64), out


def _ready(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, counted and raw, from rows with ``text``."""
    out = text_counts(rows.select(*keep, "text", whole(F.col("text")).cast("binary").alias("raw")))
    return out.select(*keep, F.array(*counted()).alias("counted"), "raw")


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_labelled: int) -> Ranker:
    """Fit on about ``max_labelled`` labelled rows, never more, chosen by hash of the key."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("__id")).agg(F.min(label).cast("int").alias("label"))
    known = materialize(bounded(known, F.col("__id"), max_labelled), "labelled")
    # At most max_labelled rows of 12 bytes: 72 kB.
    rows = docs.select(F.col(key).alias("__id"), whole(F.col(text)).alias("text")).join(F.broadcast(known), "__id")
    rows = rows.select(F.xxhash64("__id").alias("h"), "label", "text")
    worse = rows.filter((F.col("label") == 1) & (F.pmod("h", F.lit(CORRUPT_EVERY)) == 0)).mapInArrow(_corrupt, "h long, label int, text string")
    ready = _ready(rows.unionByName(worse), "h", "label").mapInArrow(_features, "h long, label int, x binary")
    # Rows of the table that share a key must not raise the number beyond twice the bound; a
    # row is some 9 kB, so some MB are read at a time.
    ready = materialize(ready, "features").repartitionByRange(FIT_PARTS, "h", "label", "x").sortWithinPartitions("h", "label", "x")
    h, kind, x = _stacked(ready, 2 * max_labelled)
    first = {int(a): k for k, (a, b) in enumerate(zip(h, kind, strict=True)) if b == 1}
    bad = np.array([k for k in np.flatnonzero(kind >= 2) if int(h[k]) in first], np.int64)
    return fit(x, kind == 1, (np.array([first[int(h[k])] for k in bad], np.int64), bad), COUNTED)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(key, held_out, score, predicted) per row; null and empty texts are scored too.

    Only the labels of rows that are not held out are read, and no score reads a label, a
    key or a column but the text. Of several labels of one key the least counts.
    """
    ranker = learn(docs, labels, key, text, label, max_labelled)
    kind = docs.schema[key].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in _batched(b):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo).cast(arrow), pa.array(np.round(ranker.score(x), 6))], names=["id", "score"])

    ready = _ready(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")
    scored = ready.mapInArrow(run, f"id {kind.simpleString()}, score double")
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
