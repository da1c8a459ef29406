"""Row numbers and exact quantiles of a whole table without one task that sees all of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.hubs import large_groups
from tessella.plans.materialize import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order given, which must leave no ties.

    Rows are dealt by range and sorted in their parts; a row's number is its place there
    and the rows of the parts before, one short row per part.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(dealt.select("*", F.monotonically_increasing_id().alias("__id")), "numbered")
    part = F.shiftright("__id", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row per part.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + place).drop("__id", "__part", "__before")


#: Rows of one group up to which a task may hold it.
GROUP_ROWS = 1_000_000


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, rank: str | None = None) -> DataFrame:
    """``df`` with ``rank``: 1, 2, ... in its group, and ``sums``: totals of the rows before in the group.

    The order must leave no ties in a group, and groups are not null. While the largest group
    has up to GROUP_ROWS rows this is a window. With larger ones rows are dealt by range of
    group and order: a window counts inside each part, and what the parts before hold of a
    group that goes on is added; there is at most one such group between two parts.
    """
    sums = sums or {}
    named = df.select("*", *[c.cast("long").alias(f"__{n}") for n, c in sums.items()])
    held = materialize(named, "grouped")
    large = large_groups(held, group, GROUP_ROWS)[1]
    by = [F.asc(c) if isinstance(c, str) else c for c in order]
    before, none = (Window.unboundedPreceding, -1), F.lit(0).cast("long")

    def counted(rows: DataFrame, window) -> DataFrame:
        out = {n: F.coalesce(F.sum(f"__{n}").over(window.rowsBetween(*before)), none) for n in sums}
        return rows.withColumns(out | ({rank: F.row_number().over(window).cast("long")} if rank else {}))

    if large is None or large.isEmpty():
        return counted(held, Window.partitionBy(*group).orderBy(*by)).drop(*[f"__{n}" for n in sums])
    dealt = held.repartitionByRange(*[F.asc(g) for g in group], *by).sortWithinPartitions(*group, *by)
    dealt = materialize(dealt.select("*", F.monotonically_increasing_id().alias("__id")), "dealt").withColumn("__part", F.shiftright("__id", 33))
    inside = counted(dealt, Window.partitionBy("__part", *group).orderBy("__id"))
    per = dealt.groupBy("__part", *group).agg(F.count("*").alias("__rows"), *[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    split = per.groupBy(*group).agg(F.count("*").alias("__parts")).filter("__parts > 1").drop("__parts")
    over = Window.partitionBy(*group).orderBy("__part").rowsBetween(*before)
    carried = per.join(split, group).select("__part", *group, *[F.coalesce(F.sum(c).over(over), none).alias(f"__c{c}") for c in ("__rows", *[f"__{n}" for n in sums])])
    # Two rows a part at most.
    out = inside.join(F.broadcast(materialize(carried, "carried")), ["__part", *group], "left")
    added = {n: F.col(n) + F.coalesce(f"__c__{n}", none) for n in sums} | ({rank: F.col(rank) + F.coalesce("__c__rows", none)} if rank else {})
    return out.withColumns(added).select(*df.columns, *added)


#: Ranges of values that are counted at once, and values that are read to pick from.
RANGES, READ = 4096, 100_000


def exact_quantile(df: DataFrame, column: str, p: float) -> float | None:
    """The p-quantile with linear interpolation; None of no values.

    Values are counted by equal ranges between the least and the largest, and the range that
    holds the wanted place is cut again until it has few values or one; these are read. No
    values are sorted or written, and a pass returns RANGES short rows at most. ``df`` is
    scanned three times or so.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and x <> double('NaN')")
    n, lo, hi = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = (n - 1) * p
    first = math.floor(place)
    low = _nth(values, first, lo, hi, n)
    if place == first:
        return low
    # The next place holds the same value, or the next larger one: one more scan.
    upto, above = values.agg(F.count(F.when(F.col("x") <= low, 1)), F.min(F.when(F.col("x") > low, F.col("x")))).first()
    high = low if upto > first + 1 else above
    return low if low == high else low + (high - low) * (place - first)


def _nth(values: DataFrame, k: int, lo: float, hi: float, n: int) -> float:
    """The value at place k (from 0) of those n in lo..hi."""
    while lo < hi and n > READ:
        if math.isinf(hi) or math.isinf(lo) or math.isinf(hi - lo):
            # Infinities stand at the ends; between them the range is halved to be finite.
            part = F.when(F.col("x") == float("inf"), 2).when(F.col("x") == float("-inf"), -1).otherwise(F.when(F.col("x") < 0, 0).otherwise(1))
        else:
            part = F.floor((F.col("x") - lo) / (hi - lo) * RANGES)
        inside = values.filter((F.col("x") >= lo) & (F.col("x") <= hi))
        # RANGES + 1 rows at most.
        parts = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(parts, key=lambda r: r["part"]):
            if k < r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    if lo == hi:
        return lo
    # READ values at most.
    return sorted(r[0] for r in values.filter((F.col("x") >= lo) & (F.col("x") <= hi)).collect())[k]
