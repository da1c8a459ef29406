"""Whitening of embeddings from exact covariances found by polarisation.

Entries become whole numbers. For every dimension, and for the sum of every two dimensions,
squares of centred values are summed exactly; as (a + b)**2 - a**2 - b**2 = 2 a b, the
differences of these variances are the covariances. They are formed as whole numbers of any
size, so nothing is lost before the one division, and go to ``eigh``.

Tasks centre on the whole part of the mean, which keeps squares small; what is left of the
mean, r / n, is taken out of the sums exactly: with z = x - floor(mean) and r = sum(z),
sum((n x - S)**2) = n**2 sum(z**2) - n r**2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Vectors that a task handles at once.
ROWS = 4096
#: Whole numbers that a long holds with room for a sum of two.
_WIDE = 1 << 61
_SUMS = "i int, j int, total string"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, values, bad): list sizes (-1 for null), all entries in a row, and which are no numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return sizes, values, bad | ~np.isfinite(values)


def _usable(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vector: places of the usable vectors, and their whole numbers less SHIFT."""
    sizes, values, bad = _lists(column)
    # An entry whose whole number is no long has no place here either.
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
    bad |= ~(np.abs(scaled) < float(_WIDE))
    ends = np.cumsum(np.maximum(sizes, 0))
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    starts = ends - np.maximum(sizes, 0)
    good = (sizes > 0) & (spoilt[ends] == spoilt[starts])
    out = {}
    for size in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == size))
        out[size] = at, scaled[starts[at][:, None] + np.arange(size)].astype(np.int64)
    return out


def _exact_sum(block: np.ndarray, power: int = 1) -> list[int]:
    """Sums of the columns of whole numbers, or of their squares, without overflow."""
    if not len(block):
        return [0] * block.shape[1]
    most = max(abs(int(block.min())), abs(int(block.max())), 1)
    if most**power * len(block) < _WIDE:
        return (block if power == 1 else block * block).sum(axis=0).tolist()
    wide = block.astype(object)
    return (wide if power == 1 else wide * wide).sum(axis=0).tolist()


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            piece = b.slice(lo, ROWS)
            yield piece, _usable(piece.column(column))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vector (i) and dimension (j): sum of the whole numbers; j = -1: number of vectors."""
    totals: dict[tuple[int, int], int] = {}
    for _, found in _pieces(batches, "vector"):
        for size, (at, x) in found.items():
            for j, s in enumerate([len(at), *_exact_sum(x)], -1):
                totals[size, j] = totals.get((size, j), 0) + s
    yield _sums(totals)


def _sums(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    i, j = (pa.array([k[x] for k in totals], pa.int32()) for x in (0, 1))
    return pa.RecordBatch.from_arrays([i, j, pa.array([str(v) for v in totals.values()], pa.string())], ["i", "j", "total"])


def _pairs(size: int, centre: np.ndarray):
    """Task that sums squares of centred values (i = j) and of the sums of every two of them (i < j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (size - i) for i in range(size)]
        seen = False
        for _, found in _pieces(batches, "vector"):
            if size not in found:
                continue
            seen, z = True, _centred(found[size][1], centre)
            for i in range(size):
                sums = _exact_sum(np.concatenate([z[:, i : i + 1], z[:, i : i + 1] + z[:, i + 1 :]], axis=1), 2)
                totals[i] = [a + b for a, b in zip(totals[i], sums, strict=True)]
        yield _sums({(i, i + k): v for i, row in enumerate(totals) for k, v in enumerate(row)} if seen else {})

    return run


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre; as Python's whole numbers where a long could not hold it or a sum of two."""
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) + int(np.abs(centre).max()) >= _WIDE:
        return x.astype(object) - centre.astype(object)
    return x - centre


def _total(rows: DataFrame, task) -> DataFrame:
    """(i, j, total) over all tasks."""
    return rows.mapInArrow(task, _SUMS).groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _read(totals: DataFrame) -> dict[tuple[int, int], int]:
    """For one length of vector: at most a row for every two dimensions reaches the driver."""
    return {(r["i"], r["j"]): int(r["total"]) for r in totals.collect()}


def covariance(squares: dict[tuple[int, int], int], rest: list[int], n: int) -> np.ndarray:
    """Covariance (divisor n) from sums of squares of z and of z_i + z_j, and sums ``rest`` of z.

    2 n**2 Cov = n (Q_ij - Q_ii - Q_jj) - 2 r_i r_j, all whole numbers; each entry is rounded once.
    """
    d = len(rest)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            q = 2 * squares[i, i] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
            out[i, j] = out[j, i] = (n * q - 2 * rest[i] * rest[j]) / (2 * n * n)
    return out


def _whiten(size: int, n: int, centre: np.ndarray, rest: list[int], into: np.ndarray):
    """Task that gives each usable vector its deviation and its whitened values."""
    left, r = np.array([r / n for r in rest]), np.array(rest, np.int64)

    def deviations(z: np.ndarray) -> list[int | None]:
        most = n * (max(abs(int(z.min())), abs(int(z.max()))) + 1)
        y = n * z - r if most * most * size < _WIDE else n * z.astype(object) - r.astype(object)
        sums = (y * y).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _pieces(batches, "vector"):
            if size not in found:
                continue
            at, x = found[size]
            z = _centred(x, centre)
            w = (z.astype(np.float64) - left) @ into
            offsets = pa.array(np.arange(len(at) + 1) * into.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), pa.array(deviations(z), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["id", "deviation", "w"]
            )

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened values (i = -1) and of the products of every two of them."""
    total = None
    for b in batches:
        if b.num_rows:
            w = b.column("w").flatten().to_numpy().reshape(b.num_rows, -1)
            now = np.concatenate([w.sum(axis=0)[None], w.T @ w])
            total = now if total is None else total + now
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel() - 1, pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])


def identity_error(whitened: DataFrame, n: int) -> float | None:
    """Largest entry of the covariance of the column ``w`` less the identity, in size; None without components."""
    summed = whitened.select("w").mapInArrow(_moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    # A row for every two components.
    got = {(r["i"], r["j"]): r["total"] / n for r in summed.collect()}
    pairs = [(i, j) for i, j in got if i >= 0]
    return max((abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i, j in pairs), default=None)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row of ``rows`` and component: key, component, n, deviation, whitened, explained, identity_error.

    Left out are vectors that are null or empty, hold a null, an infinity or no number, or an entry
    whose whole number floor(64 c) is 2**61 or more in size; and vectors of another length than most
    have (of lengths as frequent the larger counts), which are points of another space. Components
    without variance, as when all vectors are equal or there are fewer than dimensions, cannot be
    scaled: their ``whitened`` is null, and identity_error is that of the others (null if there are
    none). A deviation over 2**63 is null. ``explained`` is 0 where there is no variance at all.
    Repeated rows each count and each get their rows, as do rows with a null key; an empty table
    has no rows; other columns are not read.
    """
    held = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    # Lengths may be many; only the one that most vectors have reaches the driver.
    counts = materialize(_total(held.select("vector"), _count), "counts")
    most = counts.filter("j = -1").orderBy(F.desc("total"), F.desc("i")).first()
    kind = dict(held.dtypes)["id"]
    if most is None:
        none = "cast(null as double)"
        return held.limit(0).selectExpr(f"id as `{key}`", "0 as component", "0L as n", "0L as deviation", f"{none} as whitened", f"{none} as explained", f"{none} as identity_error")
    size, n = most["i"], int(most["total"])
    first = _read(counts.filter(F.col("i") == size))
    sums = [first[size, j] for j in range(size)]
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    v = covariance(_read(_total(held.select("vector"), _pairs(size, centre))), rest, n)
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    flat = int((e > max(e[0], 0.0) * size * np.finfo(float).eps).sum())
    shown, scaled = min(components, size), min(components, flat)
    into = p[:, :scaled] / np.sqrt(e[:scaled])
    done = held.mapInArrow(_whiten(size, n, centre, rest, into), f"id {kind}, deviation long, w array<double>")
    done = materialize(done, "whitened")
    error = identity_error(done, n) if scaled else None
    trace = float(np.trace(v))
    explained = [max(float(x), 0.0) / trace if trace else 0.0 for x in e[:shown]]
    out = done.select("id", "deviation", "w", F.posexplode(F.array(*[F.lit(x) for x in explained])).alias("k", "explained"))
    return out.select(
        F.col("id").alias(key), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("k")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"),
    )
