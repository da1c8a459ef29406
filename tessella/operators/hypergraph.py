"""Reads as weighted hyperedges over contigs, and their projection to a weighted graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import exact_quantile, numbered, running
from tessella.operators.tiles import TILE, pairs_within
from tessella.plans.materialize import materialize

GEOMETRIC, ARITHMETIC, HARMONIC = 1, 2, 3


def vertex_filter(entries: DataFrame, factor: float = 1.0, edge: str = "read", weight: str = "weight", together: bool = False) -> DataFrame:
    """Entries whose weight is factor / 2 of the mean of the edge's other weights, or more.

    An edge with one entry passes. Null weights are left out before. A factor of 0 or less
    counts as 1. Surviving weights lose their fractions. ``together`` says that an edge's entries are
    in one partition and are no hub's, as of ``hubs.gathered``; then nothing is shuffled.
    """
    marked = with_totals(entries, edge, weight, together)
    return marked.filter(passes(factor, weight)).drop("__n", "__total").withColumn(weight, F.col(weight).cast("long"))


def with_totals(entries: DataFrame, edge: str = "read", weight: str = "weight", together: bool = False) -> DataFrame:
    """Entries of known weight with ``__n`` and ``__total``, the number and the sum of their edge's."""
    known = entries.filter(F.col(weight).isNotNull())
    if together:
        inside = Window.partitionBy(edge)
        return known.withColumns({"__n": F.count("*").over(inside), "__total": F.sum(weight).over(inside)})
    # Summed before the shuffle, so a hyperedge with very many entries is no single task's.
    sums = known.groupBy(F.col(edge).alias("__edge")).agg(F.count("*").alias("__n"), F.sum(weight).alias("__total"))
    return known.join(sums, F.col(edge).eqNullSafe(F.col("__edge"))).drop("__edge")


def passes(factor: float = 1.0, weight: str = "weight") -> Column:
    """Whether an entry of ``with_totals`` passes ``vertex_filter``."""
    factor = factor if factor and factor > 0 else 1.0
    others = (F.col("__total") - F.col(weight)) / F.nullif(F.col("__n") - 1, F.lit(0))
    return (F.col("__n") <= 1) | (F.col(weight) >= F.lit(factor) * 0.5 * others)


def labelled(merged: DataFrame) -> DataFrame:
    """(read, pos, vertex, weight[, line]): entries as they are written, by the last segment of the contig's name.

    ``line`` is the order of the reads, where ``merged`` has it as ``seen``.
    """
    line = [F.col("seen").alias("line")] if "seen" in merged.columns else []
    return merged.select("read", F.col("first").alias("pos"), F.substring_index("contig", "_", -1).alias("vertex"), "weight", *line)


def to_hyperedges(merged: DataFrame, together: bool = False) -> DataFrame:
    """(edge_id, vertex, weight, pos[, line]): contigs as numbers by their last name segment.

    A segment that is no integer spoils its read's hyperedge, which is left out whole, as a
    line of text is that has it. Of two contigs of a read with one number the last weight in
    order stays. ``together`` is as in ``vertex_filter``.
    """
    rows = labelled(merged).withColumnRenamed("read", "edge_id").withColumn("vertex", F.col("vertex").try_cast("long"))
    line = [F.min("line").alias("line")] if "line" in rows.columns else []
    if together:
        rows = rows.withColumn("__spoilt", F.max(F.col("vertex").isNull()).over(Window.partitionBy("edge_id")))
        held = rows.filter(~F.col("__spoilt")).drop("__spoilt")
    else:
        spoilt = rows.filter("vertex is null").select("edge_id").distinct()
        held = rows.join(spoilt, "edge_id", "left_anti")
    return held.groupBy("edge_id", "vertex").agg(F.max_by("weight", "pos").cast("double").alias("weight"), F.min("pos").alias("pos"), *line)


def _place(vertices: DataFrame) -> DataFrame:
    """``vertices`` with ``line``, the order of the hyperedges; their ids' order where there is none."""
    return vertices if "line" in vertices.columns else vertices.withColumn("line", F.col("edge_id"))


def first_sight(vertices: DataFrame) -> DataFrame:
    """(vertex, seen): where each vertex is met first, going through the hyperedges in order."""
    return _place(vertices).groupBy("vertex").agg(F.min(F.struct("line", F.struct("pos", "vertex").alias("pos"))).alias("seen"))


def edge_weight(weights: Column, strategy: int = GEOMETRIC, power: float = 1.0) -> Column:
    """Weight of a hyperedge from the array of its vertices' weights, in order.

    1: the k-th root of the product, 0 if that is 0; 2: the mean; 3: the harmonic mean, 0 if
    any weight is 0. The product is formed as such, so it can overflow to infinity.
    """
    k = F.size(weights)
    if strategy == GEOMETRIC:
        product = F.aggregate(weights, F.lit(1.0), lambda a, w: a * w)
        value = F.when(product > 0, F.pow(product, 1 / k)).otherwise(F.lit(0.0))
    elif strategy == ARITHMETIC:
        value = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) / k
    elif strategy == HARMONIC:
        inverse = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.coalesce(1 / F.nullif(w, F.lit(0.0)), F.lit(0.0)))
        value = F.when(F.exists(weights, lambda w: w == 0), F.lit(0.0)).otherwise(k / inverse)
    else:
        raise ValueError(f"weight strategy {strategy} is none of 1, 2, 3")
    return F.pow(value, F.lit(power)) if power != 1.0 else value


def weigh(vertices: DataFrame, strategy: int = GEOMETRIC, power: float = 1.0, order: str = "pos") -> DataFrame:
    """(edge_id, n_vertices, weight) from (edge_id, vertex, weight, order)."""
    held = vertices.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct(order, F.col("weight").cast("double").alias("w")))).alias("x"))
    ws = F.transform("x", lambda s: s["w"])
    return held.select("edge_id", F.size("x").cast("long").alias("n_vertices"), edge_weight(ws, strategy, power).alias("weight"))


def lists(vertices: DataFrame, strategy: int = GEOMETRIC, power: float = 1.0) -> DataFrame:
    """(edge_id, line, n_vertices, weight, members): hyperedges as of ``weigh``, with the array of their vertices in order."""
    item = F.struct("pos", "vertex", F.col("weight").cast("double").alias("w"))
    held = _place(vertices).groupBy("edge_id").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(item)).alias("x"))
    ws, members = F.transform("x", lambda s: s["w"]), F.transform("x", lambda s: s["vertex"])
    return held.select("edge_id", "line", F.size("x").cast("long").alias("n_vertices"), edge_weight(ws, strategy, power).alias("weight"), members.alias("members"))


def project(edges: DataFrame, seen: bool = False) -> DataFrame:
    """(a, b, w[, seen]) with a < b from ``lists``: per pair of vertices, the weights of the hyperedges with both.

    Pairs are made where their hyperedge lies and sums formed before the only shuffle; a hyperedge of over
    TILE vertices is cut into tiles. ``edges`` are read twice, so write them first. ``seen`` is where a pair is
    met first; in a hyperedge pairs go by the first's place, then the second's.
    """
    small = edges.filter(F.col("n_vertices").between(2, TILE)).select("line", "weight", "members", F.posexplode("members").alias("i", "x"))
    rest = F.slice("members", F.col("i") + 2, F.greatest(F.size("members") - F.col("i") - 1, F.lit(0)))
    pairs = small.select("line", "weight", "i", "x", F.posexplode(rest).alias("k", "y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight", "line", "i", (F.col("i") + 1 + F.col("k")).alias("j"))
    large = edges.filter(F.col("n_vertices") > TILE)
    if not large.isEmpty():
        rows = large.select("edge_id", "line", "weight", "n_vertices", F.posexplode("members").alias("pos", "vertex"))
        met = pairs_within(rows, ["edge_id"], "vertex", ["line", "weight", "pos"], "n_vertices")
        pairs = pairs.unionByName(met.select(F.col("vertex").alias("a"), F.col("vertex_b").alias("b"), "weight", "line", F.least("pos", "pos_b").alias("i"), F.greatest("pos", "pos_b").alias("j")))
    first = [F.min(F.struct("line", "i", "j")).alias("seen")] if seen else []
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("w"), *first)


def percentile_filter(edges: DataFrame, p: float = 10, weight: str = "w") -> DataFrame:
    """Edges of the p-th percentile (linear interpolation, exact) or more; none of none."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies in 0..100")
    cut = exact_quantile(edges, weight, p / 100)
    return edges if cut is None else edges.filter(F.col(weight) >= F.lit(cut))


def distribution(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Least, largest, mean and median weight and the number of edges, in one row."""
    middle = exact_quantile(edges, weight, 0.5)
    return edges.agg(
        F.min(weight).alias("min_w"), F.max(weight).alias("max_w"), F.avg(weight).alias("mean_w"), F.lit(middle).cast("double").alias("median_w"), F.count("*").alias("n")
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """(v, neighbor, weight): every edge from both ends."""
    one = edges.select(F.col("a").alias("v"), F.col("b").alias("neighbor"), F.col("w").alias("weight"))
    return one.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("neighbor"), F.col("w").alias("weight")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("v").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, rank, neighbor, weight): neighbours by falling weight, then id; those of a hub by ranges."""
    return running(both_ways(edges), ["v"], [F.desc("weight"), F.asc("neighbor")], rank="rank").select("v", "rank", "neighbor", "weight")


def _outcomes(offers: DataFrame, acting: DataFrame, added: DataFrame) -> DataFrame:
    """(v, neighbor, weight, from, plain, given): what each acting vertex adds of its offers.

    ``acting`` has (v, need, from): ``from`` is the one vertex of an earlier turn that is
    still open, or null. ``plain`` is what happens if that one does not add v, ``given`` if it does.
    """
    # A larger vertex may act in an earlier round, but its turn comes later.
    got = added.filter("turn < n_turn").groupBy(F.col("neighbor").alias("v")).agg(F.count("*").alias("got"))
    taken = added.select(F.col("neighbor").alias("v"), F.col("v").alias("neighbor"))
    mine = offers.drop("need").join(acting, "v").join(taken, ["v", "neighbor"], "left_anti").join(got, "v", "left")
    left = F.col("need") - F.coalesce("got", F.lit(0))
    order = Window.partitionBy("v").orderBy("place")
    other = F.coalesce(F.col("neighbor") != F.col("from"), F.lit(True))
    nth, nth_other = F.row_number().over(order), F.sum(other.cast("int")).over(order)
    return mine.select("v", "neighbor", "turn", "n_turn", "weight", "from", (nth <= left).alias("plain"), (other & (nth_other <= left - 1)).alias("given"))


def _chained(open_: DataFrame, known: DataFrame) -> DataFrame:
    """(v, is): for vertices that wait for one other, whether that one adds them.

    ``open_`` has (v, neighbor, from, plain, given): v adds the neighbor as ``given`` if ``from``
    adds v and as ``plain`` if not. ``known`` has (from, v, is) for those that wait for nobody.
    Distances double over the waits, so a row of n vertices takes log2(n) steps.
    """
    asks = open_.select("v", "from").distinct()
    # is(v) as a function of is(at): ``no`` and ``yes``, until ``at`` has no open one before it.
    step = open_.select(F.col("v").alias("from"), F.col("neighbor").alias("v"), F.col("plain").alias("no"), F.col("given").alias("yes"))
    now = asks.join(step, ["from", "v"], "left").join(known, ["from", "v"], "left")
    now = materialize(now.select("v", F.when(F.col("no").isNotNull(), F.col("from")).alias("at"), "no", "yes", "is"), "asks")
    while not now.filter("`is` is null and at is not null").isEmpty():
        on = now.select(F.col("v").alias("at"), F.col("at").alias("at2"), F.col("no").alias("no2"), F.col("yes").alias("yes2"), F.col("is").alias("is2"), F.lit(True).alias("there"))
        both = now.join(on, "at", "left")
        def through(x):
            return F.when(F.col(x), F.col("yes")).otherwise(F.col("no"))

        known_now = F.coalesce("is", F.when(F.col("is2").isNotNull(), through("is2")))
        now = both.select(
            "v", F.when(known_now.isNull() & F.col("there"), F.col("at2")).alias("at"),
            F.when(F.col("no2").isNotNull(), through("no2")).alias("no"), F.when(F.col("yes2").isNotNull(), through("yes2")).alias("yes"), known_now.alias("is"),
        )
        now = materialize(now, "asks")
    return now.filter("`is` is not null").select("v", "is")


def _with_seen(edges: DataFrame, seen: DataFrame | None) -> DataFrame:
    if seen is not None:
        return edges.drop("seen").join(seen.select("a", "b", "seen"), ["a", "b"])
    return edges if "seen" in edges.columns else edges.withColumn("seen", F.struct("a", "b"))


def top_up(kept: DataFrame, all_edges: DataFrame, min_degree: int = 1, seen: DataFrame | None = None) -> DataFrame:
    """``kept`` and, for vertices short of ``min_degree``, their heaviest further edges.

    Vertices take turns, and an edge that one adds counts for its neighbour too. ``seen``
    (a, b, seen) has the order of the pairs; without it ``kept`` and ``all_edges`` may have it as a
    column, as of ``project``, and else pairs are ordered by (a, b). Turns go by the first kept edge of a vertex, its lesser vertex first;
    among edges of one weight the pair seen first counts. Whatever happens before its turn, a
    vertex can only add from its first ``min_degree - degree`` offers, so it has to wait for no
    more than those short vertices of earlier turns that have it among theirs. All that wait for
    nobody act in one round, and with them those that wait for one other only, whatever that one
    waits for, by doubling. Up to 1 nothing can be short, as every vertex of a kept edge has one.
    """
    if min_degree <= 1:
        return kept.drop("seen")
    placed, every = (_with_seen(x, seen) for x in (kept, all_edges))
    base = kept.select("a", "b", F.col("w").cast("double").alias("w"))
    lacks = degrees(base).filter(F.col("degree") < min_degree).select("v", (min_degree - F.col("degree")).alias("need"))
    lacks = materialize(lacks, "lacks")
    near = placed.select("seen", F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("side")), F.struct(F.col("b").alias("v"), F.lit(1).alias("side")))).alias("x")).select("seen", "x.*")
    turns = near.join(lacks, "v").groupBy("v").agg(F.min(F.struct("seen", "side")).alias("at"), F.min("need").alias("need"))
    short = materialize(numbered(turns, [F.asc("at")], "turn").select("v", "need", "turn"), "short")
    # Of all edges only those of short vertices go on.
    arcs = [every.select(F.col(x).alias("v"), F.col(y).alias("neighbor"), F.col("w").alias("weight"), "seen").join(short, "v") for x, y in (("a", "b"), ("b", "a"))]
    open_ = arcs[0].unionByName(arcs[1]).join(both_ways(base).select("v", "neighbor"), ["v", "neighbor"], "left_anti")
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("weight"), "seen"))
    offers = open_.withColumn("place", place).filter("place <= need").select("v", "neighbor", "weight", "need", "turn", "place")
    offers = offers.join(short.select(F.col("v").alias("neighbor"), F.col("turn").alias("n_turn")), "neighbor", "left")
    offers = materialize(offers, "offers")
    waits = materialize(offers.filter("turn < n_turn").select("v", "neighbor"), "waits")
    added = materialize(offers.limit(0).select("v", "neighbor", "turn", "n_turn", "weight"), "added")
    left = short.select("v", "need")
    while not left.isEmpty():
        before = waits.join(left.select("v"), "v").groupBy(F.col("neighbor").alias("v")).agg(F.count("*").alias("open"), F.min("v").alias("from"))
        acting = left.join(before, "v", "left").filter("open is null or open = 1").select("v", "need", "from")
        done = materialize(_outcomes(offers, acting, added), "outcomes")
        known = waits.join(left.select("v"), "v").join(acting.filter("`from` is null").select("v"), "v", "left_semi")
        known = known.join(done.filter("`from` is null and plain").select("v", "neighbor", F.lit(True).alias("is")), ["v", "neighbor"], "left")
        known = known.select(F.col("v").alias("from"), F.col("neighbor").alias("v"), F.coalesce("is", F.lit(False)).alias("is"))
        found = _chained(acting.filter("`from` is not null").select("v", "from").join(done.select("v", "neighbor", "plain", "given"), "v", "left"), known)
        settled = materialize(done.join(found, "v", "left").withColumn("adds", F.when(F.col("from").isNull() | ~F.col("is"), F.col("plain")).when(F.col("is"), F.col("given"))), "settled")
        added = materialize(added.unionByName(settled.filter("adds").select("v", "neighbor", "turn", "n_turn", "weight")), "added")
        over = acting.filter("`from` is null").select("v").unionByName(found.select("v"))
        left = materialize(left.join(over, "v", "left_anti"), "left")
    more = added.select(F.least("v", "neighbor").alias("a"), F.greatest("v", "neighbor").alias("b"), F.col("weight").cast("double").alias("w"))
    return base.unionByName(more)
