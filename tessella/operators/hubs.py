"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize

#: Rows of one key that a task may hold, and keys with more of them than that, at most.
HUB_ROWS, HUBS = 100_000, 10_000
#: Counts by which hubs are looked for.
COUNTS = 1 << 16


def hub_limit(total: int) -> int:
    """Rows from which a key of a table of ``total`` rows is a hub: fewer than HUBS keys have more."""
    return max(HUB_ROWS, total // HUBS)


def join_split(rows: DataFrame, side: DataFrame, key: str, hubs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key; the keys of ``rows`` are not null.

    Rows of ``hubs`` (key) stay where they are: the hubs' rows of ``side``, fewer than HUBS by
    ``hub_limit``, are broadcast. All others meet by a shuffle, in which no key has more rows
    than the limit. ``rows`` and ``side`` are read twice, so write them first.
    """
    few = F.broadcast(hubs.select(key))
    held = rows.join(F.broadcast(side.join(few, key, "left_semi")), key)
    return held.unionByName(rows.join(few, key, "left_anti").join(side, key))


def large_groups(rows: DataFrame, keys: list[str], most: int) -> tuple[int, DataFrame | None]:
    """The number of rows, and (keys, n) of the groups with over ``most`` rows, null being a key too; None if there surely is none.

    Rows are counted by COUNTS hashes of the keys first, and groups only under hashes that hold enough for one.
    """
    hashed = F.pmod(F.xxhash64(*keys), F.lit(COUNTS))
    counts = rows.groupBy(hashed.alias("h")).agg(F.count("*").alias("n"))
    # COUNTS numbers at most.
    total, full = counts.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > most, F.col("h")))).first()
    if not full:
        return total or 0, None
    held = rows.withColumn("__h", hashed).join(F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in full], "__h long")), "__h")
    return total, held.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def hub_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """(key) of the keys with over ``hub_limit`` rows, null being one of them; None if there is none."""
    total, large = large_groups(rows, [key], HUB_ROWS)
    if large is None:
        return None
    found = materialize(large.filter(F.col("n") > hub_limit(total)).select(key), "hubs")
    return None if found.isEmpty() else found


def gathered(rows: DataFrame, key: str, step: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``step(rows, True)`` with all rows of a key in one partition, so that what it groups by the key and more needs no shuffle.

    Rows of hubs are left to ``step(rows, False)``, which finds them dealt in any way.
    """
    hubs = hub_keys(rows, key)
    if hubs is None:
        return step(rows.repartition(key), True)
    few = F.broadcast(hubs.select(F.col(key).alias("__hub")))
    same = F.col(key).eqNullSafe(F.col("__hub"))
    return step(rows.join(few, same, "left_anti").repartition(key), True).unionByName(step(rows.join(few, same, "left_semi"), False))
