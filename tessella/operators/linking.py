"""Greedy path covers over contig ends, their merge, and chains.

Inside each partition, edges between ends of contigs are taken by falling weight (ties by
the ends' names) if both ends are free and the edge closes no cycle. A sequential pass is
not needed for that: call the paths formed so far fragments. Let an edge be the best of all
edges left at one of its fragments, and u its end on the other side. Nothing can happen to
the first fragment before the edge's turn, so the edge closes no cycle then, and the pass
takes it exactly if u is still free:

* If no better edge is left at u, it is taken.
* If one better edge is left at u, it waits for that one, and is taken if that one is not.
  Such waits form a forest, whose paths are halved by pointer doubling.

What is taken is in the pass's result whatever comes later, so an edge between two ends of
one fragment, or at an end in use, never is. Rounds go on until nothing is left; once few
edges are left, the rest is finished partition by partition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.operators.numbering import running
from tessella.plans.materialize import materialize

INTERNAL, SIMILARITY_BOOST, MIN_EDGE_WEIGHT, DROP = 100_000.0, 100_000.0, 20.0, 0.3
#: Edges left, over all partitions, from which they are finished in grouped tasks.
LOCAL_EDGES = 100_000


def candidate_edges(weights: DataFrame, members: DataFrame, floor: float = MIN_EDGE_WEIGHT) -> DataFrame:
    """(partition, a, b, w) from (ep_a, ep_b, contig_a, contig_b, w): usable and distinct.

    Both contigs in one partition, not one contig, a positive weight of ``floor`` or more; of
    several edges of one pair the heaviest. ``members`` has (partition, contig).
    """
    held = weights.filter((F.col("w") > 0) & (F.col("w") >= floor) & (F.col("contig_a") != F.col("contig_b")))
    for side in "ab":
        held = held.join(members.select(F.col("contig").alias(f"contig_{side}"), F.col("partition").alias(f"p{side}")), f"contig_{side}")
    held = held.filter("pa = pb")
    return held.groupBy(F.col("pa").alias("partition"), F.least("ep_a", "ep_b").alias("a"), F.greatest("ep_a", "ep_b").alias("b")).agg(F.max("w").alias("w"))


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """The greedy pass over what is left of one partition; fa and fb are the ends' fragments."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used, taken = set(), []
    rows = pdf.sort_values(["w", "a", "b"], ascending=[False, True, True])
    for r in rows.itertuples(index=False):
        if r.a in used or r.b in used:
            continue
        x, y = root(r.fa), root(r.fb)
        if x != y:
            parent[y] = x
            used.update((r.a, r.b))
            taken.append((r.partition, r.a, r.b, r.w))
    return pd.DataFrame(taken, columns=["partition", "a", "b", "w"])


def _waits_solved(waits: DataFrame, taken: DataFrame) -> DataFrame:
    """(edge) of those that are taken among ``waits`` (edge, to): an edge is, if the one that it waits for is not.

    ``taken`` has the (edge)s taken for sure. What waits, over others, for an edge that
    neither is taken nor waits stays open. Distances double, so a row of n waits takes
    log2(n) steps.
    """
    mark = taken.select(F.col("edge").alias("to"), F.lit(True).alias("known"))
    # taken(edge) = taken(to), the other way round if odd; ``is`` once it is known.
    now = waits.join(mark, "to", "left").select("edge", "to", F.lit(True).alias("odd"), F.when(F.col("known"), False).alias("is"))
    now = materialize(now, "waits")
    while not now.filter("`is` is null and to is not null").isEmpty():
        on = now.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("odd").alias("odd2"), F.col("is").alias("is2"), F.lit(True).alias("there"))
        both = now.join(on, "to", "left")
        known = F.coalesce("is", F.col("is2") != F.col("odd"))
        now = both.select(
            "edge",
            F.when(known.isNull() & F.col("there"), F.col("to2")).alias("to"),
            F.when(F.col("there"), F.col("odd") != F.col("odd2")).otherwise(F.col("odd")).alias("odd"),
            known.alias("is"),
        )
        now = materialize(now, "waits")
    return now.filter("`is`").select("edge")


def _decided(left: DataFrame) -> DataFrame:
    """The rows of ``left`` (partition, a, b, w, fa, fb) that are taken for sure, some at least."""
    edge = F.struct("partition", (-F.col("w")).alias("w"), "a", "b")
    one, other = F.struct(F.col("fa").alias("frag"), F.col("a").alias("near"), F.col("b").alias("far")), F.struct(F.col("fb").alias("frag"), F.col("b").alias("near"), F.col("a").alias("far"))
    sides = left.select("partition", edge.alias("edge"), F.explode(F.array(one, other)).alias("x")).select("partition", "edge", "x.*")
    offers = sides.groupBy("partition", "frag").agg(F.min(F.struct("edge", "far")).alias("x")).select("partition", "x.edge", F.col("x.far").alias("near"))
    tops = sides.groupBy("partition", "near").agg(F.min("edge").alias("top"))
    asked = materialize(offers.join(tops, ["partition", "near"]), "asked")
    taken = materialize(asked.filter("edge = top").select("edge").distinct(), "taken")
    second = asked.filter("edge <> top").groupBy("partition", "near").agg(F.min("edge").alias("second"), F.min("top").alias("top"))
    second = materialize(second, "second")
    ahead = sides.join(second, ["partition", "near"]).filter(F.col("edge") < F.col("second"))
    waits = ahead.groupBy("partition", "near").agg(F.count("*").alias("n"), F.min("second").alias("edge"), F.min("top").alias("to")).filter("n = 1").select("edge", "to")
    waits = waits.join(taken, "edge", "left_anti")
    sure = taken.unionByName(_waits_solved(waits, taken)).select("edge.partition", "edge.a", "edge.b")
    return left.join(sure, ["partition", "a", "b"])


def greedy_path_cover(edges: DataFrame, members: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(partition, a, b, w): the external edges that the greedy pass accepts.

    ``edges`` as of ``candidate_edges``; ``members`` has (partition, contig), each contig a
    fragment with its two ends free at first. The best of all edges that are left is taken
    in every round, so rounds come to an end.
    """
    kind = dict(edges.dtypes)["partition"]
    ends = members.select("partition", F.explode(F.array(*[F.concat("contig", F.lit(f"_{s}")) for s in (1, 2)])).alias("ep"), F.col("contig").alias("frag"))
    ends = materialize(ends, "ends")
    left, accepted = materialize(edges.select("partition", "a", "b", F.col("w").cast("double").alias("w")), "left"), []
    while True:
        for side in "ab":
            left = left.join(ends.select("partition", F.col("ep").alias(side), F.col("frag").alias(f"f{side}")), ["partition", side])
        left = materialize(left.filter("fa <> fb").select("partition", "a", "b", "w", "fa", "fb"), "left")
        n = left.count()
        if not n:
            break
        if n <= local_edges:
            accepted.append(left.groupBy("partition").applyInPandas(_finish, f"partition {kind}, a string, b string, w double"))
            break
        took = materialize(_decided(left), "took")
        accepted.append(took.select("partition", "a", "b", "w"))
        closed = took.select("partition", F.explode(F.array("a", "b")).alias("ep"))
        # Whole paths of fragments may join in one round.
        joined = connected_components(took.select(*[F.struct("partition", F.col(f"f{x}").alias("frag")).alias(x) for x in "ab"]))
        joined = joined.select("node.partition", "node.frag", F.col("component.frag").alias("into"))
        ends = ends.join(closed, ["partition", "ep"], "left_anti").join(joined, ["partition", "frag"], "left")
        ends = materialize(ends.select("partition", "ep", F.coalesce("into", "frag").alias("frag")), "ends")
        left = left.select("partition", "a", "b", "w")
    out = edges.limit(0).select("partition", "a", "b", F.col("w").cast("double").alias("w"))
    for part in accepted:
        out = out.unionByName(part)
    return out


def two_phase(sim: DataFrame, cov: DataFrame, members: DataFrame, boost: float = SIMILARITY_BOOST, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(partition, a, b, w): accepted similarity edges, boosted, and coverage edges, covered again."""
    both = sim.withColumn("w", F.col("w") + boost).unionByName(cov)
    merged = both.groupBy("partition", "a", "b").agg(F.max("w").alias("w"))
    return greedy_path_cover(materialize(merged, "both"), members, local_edges)


def path_positions(links: DataFrame, vertices: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(v, start, pos): place of each vertex on its path, from the end with the least order.

    ``links`` has (a, b) with every vertex in two links at most and no cycles; ``vertices``
    (v, ord). Every link is an arc either way; an arc's follower leaves its head by the
    other link. Distances double per round, so a path of n takes log2(n) rounds.
    """
    arcs = links.select(F.col("a").alias("p"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("p"), F.col("a").alias("v")))
    arcs = materialize(arcs, "arcs")
    nexts = arcs.select(F.col("p").alias("v"), F.col("v").alias("w"))
    state = arcs.join(nexts, "v", "left").withColumn("w", F.when(F.col("w") != F.col("p"), F.col("w")))
    state = state.groupBy("p", "v").agg(F.max("w").alias("w"))
    # (p, v): after dist steps from p over v the walk is at ``at``, coming from ``via``.
    state = state.select("p", "v", F.lit(1).cast("long").alias("dist"), F.col("v").alias("via"), F.col("w").alias("at"), F.col("v").alias("end"))
    state = materialize(state, "walk")
    for _ in range(max_rounds):
        if state.filter("at is not null").isEmpty():
            break
        on = state.select(F.col("p").alias("via"), F.col("v").alias("at"), F.col("dist").alias("d2"), F.col("via").alias("via2"), F.col("at").alias("at2"), F.col("end").alias("end2"))
        moved = state.join(on, ["via", "at"], "left")
        state = moved.select(
            "p", "v", (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.coalesce("via2", "via").alias("via"), F.when(F.col("d2").isNotNull(), F.col("at2")).alias("at"), F.coalesce("end2", "end").alias("end")
        )
        state = materialize(state, "walk")
    else:
        raise RuntimeError("a path does not end; is there a cycle?")
    order = vertices.select(F.col("v").alias("end"), F.col("ord").alias("end_ord"))
    # A vertex sees both ends of its path, an end itself only the other one.
    seen = state.select(F.col("p").alias("v"), "end", "dist").unionByName(vertices.select("v", F.col("v").alias("end"), F.lit(0).cast("long").alias("dist")).join(_path_ends(arcs), "v"))
    ranked = seen.join(order, "end")
    first = ranked.groupBy("v").agg(F.min_by(F.struct("end", "dist"), "end_ord").alias("s"))
    alone = vertices.join(arcs.select(F.col("p").alias("v")).distinct(), "v", "left_anti").select("v", F.col("v").alias("start"), F.lit(0).cast("long").alias("pos"))
    return first.select("v", F.col("s.end").alias("start"), F.col("s.dist").alias("pos")).unionByName(alone)


def _path_ends(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.col("p").alias("v")).agg(F.count("*").alias("n")).filter("n = 1").select("v")


def chains(accepted: DataFrame, members: DataFrame) -> DataFrame:
    """(partition, chain_no, pos, contig, side, endpoint, w_next) of every contig's chain.

    ``members`` has (partition, contig, ord); ends stand in the order of contig and side. A
    chain starts at its first end that is free, and chains are numbered from 1 in each
    partition by the first end that they hold.
    """
    ends = members.select("partition", "contig", "ord", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))
    ends = ends.select("partition", "contig", "side", F.concat_ws("_", "contig", F.col("side").cast("string")).alias("v"), F.struct("ord", "side").alias("ord"))
    ends = materialize(ends, "ends")
    internal = members.select(F.concat("contig", F.lit("_1")).alias("a"), F.concat("contig", F.lit("_2")).alias("b"), F.lit(INTERNAL).alias("w"))
    links = materialize(internal.unionByName(accepted.select("a", "b", "w")), "links")
    placed = path_positions(links.select("a", "b"), ends.select("v", "ord"))
    held = ends.join(placed, "v")
    numbers = held.groupBy("partition", "start").agg(F.min("ord").alias("least"))
    numbers = running(numbers, ["partition"], ["least"], rank="chain_no").drop("least")
    out = materialize(held.join(numbers, ["partition", "start"]), "chains")
    after = out.select("start", (F.col("pos") - 1).alias("pos"), F.col("v").alias("next"))
    both = links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "w")
    stepped = out.join(after, ["start", "pos"], "left").withColumns({"x": F.least("v", "next"), "y": F.greatest("v", "next")})
    # least and greatest skip a null, so a chain's last end must not look up anything.
    stepped = stepped.withColumn("y", F.when(F.col("next").isNotNull(), F.col("y"))).join(both, ["x", "y"], "left")
    return stepped.select("partition", "chain_no", "pos", "contig", "side", F.col("v").alias("endpoint"), F.col("w").alias("w_next"))


def split_on_drop(steps: DataFrame, drop: float = DROP) -> DataFrame:
    """``steps`` with ``piece``: chains cut where a weight falls under drop * the one before.

    ``steps`` has (chain, pos, w, internal): the link from pos to pos + 1, places without
    gaps. An internal link makes the next one have none before it, so in chains of two-ended
    contigs, where every other link is internal, nothing is ever cut. The link before is
    joined by its place, and runs and pieces are counted by running sums, so a very long
    chain is not one task's.
    """
    steps = materialize(steps, "steps")
    before = steps.filter("not internal").select("chain", (F.col("pos") + 1).alias("pos"), F.col("w").alias("__before"))
    low = steps.filter("not internal").join(before, ["chain", "pos"]).filter((F.col("__before") > 0) & (F.col("w") < F.col("__before") * F.lit(drop)))
    # After a cut there is no weight before either: of low links in a row every other one cuts.
    placed = running(low.select("chain", "pos"), ["chain"], ["pos"], rank="__no").withColumn("__run", F.col("pos") - F.col("__no"))
    cuts = running(placed, ["chain", "__run"], ["pos"], rank="__nth").filter("__nth % 2 = 1").select("chain", "pos", F.lit(1).cast("long").alias("__cut"))
    counted = running(steps.join(cuts, ["chain", "pos"], "left").withColumn("__cut", F.coalesce("__cut", F.lit(0).cast("long"))), ["chain"], ["pos"], {"piece": F.col("__cut")})
    return counted.withColumn("piece", F.col("piece") + F.col("__cut")).drop("__cut")
