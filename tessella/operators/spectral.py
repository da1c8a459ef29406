"""Spectral clustering of a weighted graph, the other way to communities.

Vertices are near if their rows of the adjacency matrix are; the leading eigenvectors of
the nearest-neighbour graph place every vertex, and k-means parts the places. The matrix is
an edge table and a block of vectors is a table with a row a vertex: multiplying is a join
and a sum. Only matrices of the block's width reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.hubs import hub_limit, join_split
from tessella.operators.numbering import numbered, running
from tessella.operators.tiles import TILE, pairs_within
from tessella.plans.materialize import materialize

CLUSTERS, NEIGHBOURS = 10, 50
#: Vectors beyond those asked for, blocks of them that are kept, k-means runs.
SPARE, KEPT, STARTS = 4, 24, 5
#: Residual of an eigenvector that counts as found, the square of a length that counts as none, and multiplications until an error is raised.
RESIDUAL, NONE, ROUNDS = 1e-4, 1e-10, 1000


def _arcs(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), F.col("w").cast("double").alias("w")).filter("v <> u")
    both = one.unionByName(one.select(F.col("u").alias("v"), F.col("v").alias("u"), "w"))
    return both.groupBy("v", "u").agg(F.sum("w").alias("w"))


#: Products of rows from which a block of neighbours is multiplied as matrices, for each pair of blocks of vertices.
DENSE = 500_000


def _product(group: pd.DataFrame) -> pd.DataFrame:
    """(i, j, dot) with i < j of one tile: the rows ``second`` False, times those True, or times themselves without any.

    TILE * TILE numbers each at most.
    """
    lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])

    def matrix(part: pd.DataFrame) -> np.ndarray:
        m = np.zeros((TILE, TILE))
        m[part["i"].to_numpy() % TILE, part["u"].to_numpy() % TILE] = part["w"].to_numpy()
        return m

    first = matrix(group[~group["second"]])
    dots = np.triu(first @ first.T, 1) if lo == hi else first @ matrix(group[group["second"]]).T
    i, j = np.nonzero(dots)
    return pd.DataFrame({"i": lo * TILE + i, "j": hi * TILE + j, "dot": dots[i, j]})


def _dots(arcs: DataFrame) -> DataFrame:
    """(i, j, dot) with i < j of all rows with a common neighbour; ``arcs`` (i, u, w) are of numbers without large gaps.

    Neighbours go in blocks of TILE numbers. A block whose rows make DENSE products or more for every two blocks
    of vertices that it meets is multiplied as matrices, a task for each two; of the others every product is a row.
    """
    block = F.floor(F.col("u") / TILE)
    at = F.floor(F.col("i") / TILE)
    sizes = arcs.groupBy("u").agg(F.count("*").alias("n")).groupBy(block.alias("k")).agg(F.sum(F.col("n") * F.col("n")).alias("products"))
    met = arcs.groupBy(block.alias("k")).agg(F.sort_array(F.collect_set(at)).alias("blocks"))
    tiles = F.size("blocks") * (F.size("blocks") + 1) / 2
    # A row for TILE vertices.
    known = materialize(sizes.join(met, "k").select("k", (F.col("products") / 2 >= DENSE * tiles).alias("dense"), "blocks"), "blocks")
    held = arcs.withColumns({"k": block, "at": at})
    full = held.join(known.filter("dense").select("k", "blocks"), "k").withColumn("other", F.explode("blocks"))
    full = full.select("k", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") > F.col("other")).alias("second"), "i", "u", "w")
    out = full.groupBy("k", "lo", "hi").applyInPandas(_product, "i long, j long, dot double")
    thin = known.filter("not dense").select("k")
    if not thin.isEmpty():
        rows = pairs_within(held.join(thin, "k", "left_semi").select("u", "i", "w"), ["u"], "i", ["w"])
        out = out.unionByName(rows.select("i", F.col("i_b").alias("j"), (F.col("w") * F.col("w_b")).alias("dot")))
    return out.groupBy("i", "j").agg(F.sum("dot").alias("dot"))


#: Rows of a block at least and at most, blocks that are aimed at, and arcs of a block, or that a part sends.
LEAST_ROWS, MOST_ROWS, BLOCKS, ARCS = 1024, 4096, 16, 8_000_000
#: Part of all products from which matrices are multiplied as such and not by their entries.
FULL = 1 / 300


def _laid(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Names and squares of the rows, by square, and of their entries row, column and weight, by column."""
    rows = part.drop_duplicates("i").sort_values(["sq", "i"])
    lengths = part["us"].map(len).to_numpy()
    at = np.repeat(pd.Index(rows["i"]).get_indexer(part["i"]), lengths)
    u = np.concatenate(part["us"].to_list()) + np.repeat(part["k"].to_numpy() * TILE, lengths)
    order = np.lexsort((at, u))
    return rows["i"].to_numpy(), rows["sq"].to_numpy(), at[order], u[order], np.concatenate(part["ws"].to_list())[order]


def _multiplied(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> np.ndarray:
    """The products of all rows of two blocks: TILE columns after TILE columns as matrices, and what is thin row by row."""
    dots = np.zeros((len(first[0]), len(second[0])))
    thin = []
    for k in np.intersect1d(first[3] // TILE, second[3] // TILE):
        cut = [[x[slice(*np.searchsorted(side[3], (k * TILE, (k + 1) * TILE)))] for x in side[2:]] for side in (first, second)]
        counts = [np.bincount(u - k * TILE, minlength=TILE) for _, u, _ in cut]
        if counts[0] @ counts[1] <= FULL * TILE * dots.size:
            thin.append(cut[0])
            continue
        full = [np.zeros((len(side[0]), TILE)) for side in (first, second)]
        for m, (at, u, w) in zip(full, cut, strict=True):
            m[at, u - k * TILE] = w
        dots += full[0] @ full[1].T
    if thin:
        at, u, w = (np.concatenate(x) for x in zip(*thin, strict=True))
        order = np.argsort(at, kind="stable")
        ends, begin, end = np.searchsorted(at[order], np.arange(len(dots) + 1)), np.searchsorted(second[3], u[order]), np.searchsorted(second[3], u[order], "right")
        w, length = w[order], end - begin
        for n in range(len(dots)):
            here = slice(ends[n], ends[n + 1])
            met = length[here]
            place = np.repeat(begin[here] - np.cumsum(met) + met, met) + np.arange(met.sum())
            dots[n] += np.bincount(second[2][place], np.repeat(w[here], met) * second[4][place], len(second[0]))
    return dots


def _best(dots: np.ndarray, first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...], neighbours: int) -> Iterator[pd.DataFrame]:
    """(i, j, sq, sq_j, dot): for each row of ``first`` the nearest of ``second``, whose order settles ties."""
    names, squares, others, theirs = first[0], first[1], second[0], second[1]
    most = min(neighbours, len(others))
    for begin in range(0, len(names), 256):
        here = slice(begin, begin + 256)
        far = (squares[here, None] + theirs - 2 * dots[here]).astype(np.float32)
        far[names[here, None] == others] = np.inf
        last = np.partition(far, most - 1, axis=1)[:, most - 1 : most]
        less, same = far < last, far == last
        i, j = np.nonzero(less | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= most - less.sum(axis=1, keepdims=True))))
        found = pd.DataFrame({"i": names[begin + i], "j": others[j], "sq": squares[begin + i], "sq_j": theirs[j], "dot": dots[begin + i, j]})
        yield found[found["i"] != found["j"]]


def _in_tiles(arcs: DataFrame, blocks: DataFrame, neighbours: int, tiles: int, parts: int) -> DataFrame:
    """(i, j, sq, sq_j, dot): the nearest of each row in every block of rows that it shares neighbours with.

    ``arcs`` (i, u, w) are of numbers without large gaps, ``blocks`` has (i, sq, at). Every two blocks with a common
    neighbour among TILE ones are one task's: entries are sent once for each block, and of the products, which may be all
    pairs, only the nearest are written. A task holds entries of two blocks and their products. Entries are sent from ``parts`` parts.
    """
    entry, k = F.struct((F.col("u") % TILE).cast("short").alias("u"), "w"), F.floor(F.col("u") / TILE).alias("k")
    # A row for TILE vertices.
    met = materialize(arcs.join(blocks, "i").groupBy(k).agg(F.collect_set("at").alias("blocks")), "blocks")
    packed = arcs.repartition(parts, "i").groupBy("i", k).agg(F.collect_list(entry).alias("x"))
    rows = packed.join(blocks, "i").select("at", "k", "i", "sq", F.col("x.u").alias("us"), F.col("x.w").alias("ws"))
    sent = rows.join(met, "k").withColumn("other", F.explode("blocks"))
    sent = sent.select(F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") > F.col("other")).alias("second"), "k", "i", "sq", "us", "ws")

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        first = _laid(group[~group["second"]])
        if group["lo"].iloc[0] == group["hi"].iloc[0]:
            return pd.concat(_best(_multiplied(first, first), first, first, neighbours))
        second = _laid(group[group["second"]])
        dots = _multiplied(first, second)
        return pd.concat([*_best(dots, first, second, neighbours), *_best(dots.T, second, first, neighbours)])

    return sent.repartition(min(tiles, 10_000), "lo", "hi").groupBy("lo", "hi").applyInPandas(tile, "i long, j long, sq double, sq_j double, dot double")


def _met(arcs: DataFrame, squares: DataFrame, count: int, neighbours: int) -> DataFrame:
    """(i, j, sq, sq_j, dot): of all rows with a common neighbour at least the nearest of each row.

    ``arcs`` (i, u, w) and ``squares`` (i, sq) of ``count`` rows. With DENSE products or more for every two blocks of rows it goes by blocks.
    """
    products = arcs.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    size = min(max(LEAST_ROWS, -(-count // BLOCKS)), MOST_ROWS)
    degrees = arcs.groupBy("i").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    total = arcs.count()
    most = -(-count // size) + total // ARCS
    tiles = most * (most + 1) // 2
    if products / 2 >= DENSE * tiles and tiles:
        # Both numbers rise, so a block has neither more rows nor, but for its last row's, more arcs.
        at = running(degrees, ["all"], ["i"], {"before": F.col("n")}).select("i", (F.floor(F.col("before") / ARCS) + F.floor(F.col("i") / size)).alias("at"))
        return _in_tiles(arcs, materialize(squares.join(at, "i"), "at"), neighbours, tiles, max(1, min(total * most // ARCS, 10_000)))
    met = materialize(_dots(arcs), "dots")
    met = met.select("i", "j", "dot").unionByName(met.select(F.col("j").alias("i"), F.col("i").alias("j"), "dot"))
    return met.join(squares.toDF("j", "sq_j"), "j").join(squares, "i").select("i", "j", "sq", "sq_j", "dot")


def nearest(edges: DataFrame, vertices: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(v, u, rank): for each (vertex) the ``neighbours`` others whose rows of the adjacency are nearest.

    Edges (a, b, w) have weights of zero or more; null ends or weights match nothing. Distances
    are Euclidean, in single precision; ties go to the lesser norm, then to the lesser vertex.
    Exact without all pairs: rows with a common neighbour meet there, by tiles; where these are most of all pairs,
    blocks of rows meet and only the nearest of each row in each block are written. Of the others
    the distance is that of the norms alone, so those among the nearest are among the
    ``neighbours`` rows of least norm.
    """
    arcs = materialize(_arcs(edges.dropna(subset=["a", "b", "w"])), "arcs")
    square = F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).cast("float").cast("double")
    names = vertices.select(F.col("vertex").alias("v")).dropna().distinct()
    norms = names.join(arcs, "v", "left").groupBy("v").agg(square.alias("sq"))
    norms = materialize(numbered(norms, [F.asc("v")], "i").select("v", "sq", F.col("i") - 1), "norms").toDF("v", "sq", "i")
    # ``neighbours`` rows.
    least = norms.orderBy("sq", "i").limit(neighbours + 1).collect()
    offered = F.array(*[F.struct(F.lit(r.i).cast("long").alias("j"), F.lit(r.sq).alias("sq_j"), F.lit(0.0).alias("dot")) for r in least])
    # Neighbours that are no (vertex) count too, behind the others.
    every = materialize(numbered(arcs.select(F.col("u").alias("name")).distinct().join(names.select(F.col("v").alias("name")), "name", "left_anti"), [F.asc("name")], "n"), "others")
    count = norms.count()
    every = norms.select(F.col("v").alias("u"), F.col("i").alias("at")).unionByName(every.select(F.col("name").alias("u"), (F.col("n") - 1 + count).alias("at")))
    met = arcs.join(norms.select("v", "i"), "v").join(every, "u").select("i", F.col("at").alias("u"), "w")
    near = _met(materialize(met, "placed"), norms.select("i", "sq"), count, neighbours).select("i", "sq", "j", "sq_j", "dot")
    if least:
        near = near.unionByName(norms.select("i", "sq", F.inline(offered)))
    # A pair that is offered and met has its product of rows from the latter.
    pairs = near.filter("i <> j").groupBy("i", "j").agg(F.max("dot").alias("dot"), F.first("sq").alias("sq"), F.first("sq_j").alias("sq_j"))
    far = (F.col("sq") + F.col("sq_j") - 2 * F.col("dot")).cast("float")
    order = Window.partitionBy("i").orderBy(far, "sq_j", "j")
    best = pairs.select("i", "j", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= neighbours)
    return best.join(norms.select("i", "v"), "i").join(norms.select(F.col("i").alias("j"), F.col("v").alias("u")), "j").select("v", "u", "rank")


def affinity(near: DataFrame) -> DataFrame:
    """(v, u, s, degree of v): one half for each direction in which two are near, divided by the root of both degrees."""
    one = near.select("v", "u").unionByName(near.select(F.col("u").alias("v"), F.col("v").alias("u")))
    arcs = materialize(one.groupBy("v", "u").agg((F.count("*") / 2).alias("w")), "near")
    degree = materialize(arcs.groupBy("v").agg(F.sum("w").alias("degree"), F.count("*").alias("n")), "degrees")
    hubs = degree.filter(F.col("n") > hub_limit(degree.agg(F.sum("n")).first()[0] or 0)).select("v")
    here = materialize(join_split(arcs, degree.select("v", "degree"), "v", hubs), "here")
    there = join_split(here, degree.select(F.col("v").alias("u"), F.col("degree").alias("other")), "u", hubs.withColumnRenamed("v", "u"))
    return there.select("v", "u", (F.col("w") / F.sqrt(F.col("degree") * F.col("other"))).alias("s"), "degree")


def _stacked(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_list())


def _inner(held: DataFrame, wide: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of the vectors ``b`` with those in ``y``, and of the latter, summed by part."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((wide + width, width))
        for batch in batches:
            y = _stacked(batch["y"])
            sums += np.hstack([_stacked(batch["b"]), y]).T @ y
        yield pd.DataFrame({"at": np.arange(sums.size), "x": sums.ravel()})

    # A row for each pair of vectors, KEPT blocks of them and one more.
    rows = held.select("b", "y").mapInPandas(part, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    sums = np.array([r.x for r in rows]).reshape(wide + width, width)
    return sums[:wide], sums[wide:]


def _turned(held: DataFrame, kept: np.ndarray | None, off: np.ndarray, mix: np.ndarray) -> DataFrame:
    """(v, b): the vectors ``b``, or ``kept`` mixtures of them, and after them ``mix`` of what ``y`` has beyond ``off`` of them."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = _stacked(batch["b"])
            new = (_stacked(batch["y"]) - b @ off) @ mix
            yield pd.DataFrame({"v": batch["v"], "b": list(np.hstack([b if kept is None else b @ kept, new]))})

    return held.mapInPandas(part, f"v {held.schema['v'].dataType.simpleString()}, b array<double>")


def eigenvectors(s: DataFrame, wanted: int, seed: int = 42) -> tuple[DataFrame, np.ndarray, float]:
    """(v, x0, x1, ..), values and largest residual: the leading eigenvectors of a symmetric matrix (v, u, s) with values in -1..1.

    Block Lanczos: a block of vectors is multiplied by the matrix, what the vectors so far say of the product is taken
    out, and the rest is the next block; the best vectors in the span of all blocks are taken. After KEPT
    blocks only the leading vectors so far go on, two blocks of them. The vectors are of length one and orthogonal; with equal values
    any basis may come. Every multiplication is written, so a lost executor costs one of them. Raises
    RuntimeError if residuals stay over RESIDUAL for ROUNDS multiplications.
    """
    s = materialize(s.select("v", "u", "s"), "matrix")
    per = materialize(s.groupBy("v").agg(F.count("*").alias("n")), "rows")
    count, total = per.agg(F.count("*"), F.sum("n")).first()
    hubs = materialize(per.filter(F.col("n") > hub_limit(total or 0)).select(F.col("v").alias("u")), "hubs")
    hubs = None if hubs.isEmpty() else hubs
    wanted = min(wanted, count)
    width = min(wanted + SPARE, count)
    if not width:
        return per.select("v"), np.zeros(0), 0.0
    draw = F.array(*[F.xxhash64("v", F.lit(j), F.lit(seed)) / float(2**63) for j in range(width)])
    held = per.select("v", F.array().cast("array<double>").alias("b"), draw.alias("y"))
    image, last, residual, block = np.zeros((0, 0)), 0, np.inf, width
    for _ in range(ROUNDS):
        off, own = _inner(held, len(image), width)
        rest = own - off.T @ off
        kept = None
        if last:
            # What the matrix makes of the vectors, in terms of them; that of the last block is new.
            image[:, -last:], image[-last:, :] = off, off.T
            values, turn = np.linalg.eigh((image + image.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            outside = turn[-last:, :wanted]
            residual = float(np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", outside, rest, outside), 0)).max())
            if residual <= RESIDUAL:
                # The span's basis may have lost some orthogonality.
                mixed = materialize(_turned(held, turn[:, :wanted], off, np.zeros((width, 0))).select("v", F.array().cast("array<double>").alias("b"), F.col("b").alias("y")), "vectors")
                scale, basis = np.linalg.eigh(_inner(mixed, 0, wanted)[1])
                straight = _turned(mixed, None, np.zeros((0, wanted)), (basis / np.sqrt(scale)) @ basis.T)
                return straight.select("v", *[F.col("b")[j].alias(f"x{j}") for j in range(wanted)]), values[:wanted], residual
            if len(image) + last > KEPT * block:
                kept = turn[:, : 2 * block]
                image = np.diag(values[: 2 * block])
        scale, basis = np.linalg.eigh(rest)
        # Those drawn first have any length.
        good = scale > (NONE if last else scale[-1] * 1e-13)
        new = _turned(held, kept, off, basis[:, good] / np.sqrt(scale[good]))
        before, last = len(image), int(good.sum())
        image = np.pad(image, (0, last))
        width_now = [F.col("b")[before + j].alias(f"x{j}") for j in range(last)]
        there = new.select(F.col("v").alias("u"), *width_now)
        met = s.join(there, "u") if hubs is None else join_split(s, materialize(there, "block"), "u", hubs)
        y = met.groupBy("v").agg(F.array(*[F.sum(F.col("s") * F.col(f"x{j}")) for j in range(last)]).alias("y"))
        held, width = materialize(new.join(y, "v"), "block"), last
    raise RuntimeError(f"residual {residual} after {ROUNDS} multiplications")


def spectral(edges: DataFrame, vertices: DataFrame, clusters: int = CLUSTERS, neighbours: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """(vertex, label): ``clusters`` groups of (vertex) under edges (a, b, w); label is the least of a group.

    With n vertices there are at most n - 1 groups, and n - 1 neighbours, the vertex itself
    being one of them. Up to two vertices are one group; none give no row. Repeated and null vertices count
    once and not at all; other columns are not read. A vertex is placed by the leading eigenvectors,
    divided by the root of its degree; of STARTS runs of k-means that of least cost is taken.
    """
    names = materialize(vertices.select("vertex").dropna().distinct(), "names")
    n = names.count()
    k, near = min(clusters, n - 1), min(neighbours, n - 1) - 1
    if k < 2 or near < 1:
        least = names.agg(F.min("vertex")).first()[0]
        return names.withColumn("label", F.lit(least).cast(names.schema["vertex"].dataType))
    s = materialize(affinity(nearest(edges, names, near)), "affinity")
    vectors, _, _ = eigenvectors(s, k, seed)
    degrees = s.groupBy("v").agg(F.first("degree").alias("degree"))
    # Lengths of about one, for the tolerance of k-means.
    at = F.array(*[F.col(f"x{j}") / F.sqrt("degree") * F.lit(float(n) ** 0.5) for j in range(k)])
    places = vectors.join(degrees, "v").select("v", at.alias("at"))
    places = materialize(places.repartitionByRange("v").sortWithinPartitions("v"), "places").select("v", array_to_vector("at").alias("at"))
    runs = [KMeans(k=k, seed=seed + j, featuresCol="at", predictionCol="group").fit(places) for j in range(STARTS)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    found = materialize(best.transform(places).select("v", "group"), "groups")
    labels = found.groupBy("group").agg(F.min("v").alias("label"))
    return found.join(F.broadcast(labels), "group").select(F.col("v").alias("vertex"), "label")
