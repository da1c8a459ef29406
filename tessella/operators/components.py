"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.hubs import hub_limit, join_split
from tessella.plans.materialize import materialize


def _star(edges: DataFrame, larger: bool, limit: int) -> DataFrame:
    """One star step over the written ``edges`` (u, v) with u > v; so is the result. Nodes with over ``limit`` edges are hubs."""
    around = edges
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(around.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("n")), "least")
    joined = join_split(around, least.select("u", "m"), "u", least.filter(F.col("n") > limit))
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(out.filter("u <> v").distinct(), "stars")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its least node.

    Large-star and small-star steps alternate until the edge set stops changing, which
    takes a number of rounds that grows with the logarithm of the largest component.
    Every step pre-aggregates the least neighbour per node, and is written to the shared
    folder. The edges of a hub meet its least neighbour by a broadcast of the few hubs'
    rows, so they never come together. Self loops keep their node; null ends are ignored.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    ends = materialize(ends, "edges")
    alone = ends.filter("x = y").select(F.col("x").alias("node")).distinct()
    now = ends.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    now, before = materialize(now, "stars"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
        if not mark["n"]:
            break
        limit = hub_limit(2 * mark["n"])
        now = _star(_star(now, True, limit), False, limit)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    lone = alone.join(nodes.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots).unionByName(lone)
