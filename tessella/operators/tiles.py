"""All pairs inside groups, with large groups cut into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that meet in one task, on either side; a tile has TILE ** 2 pairs at most, about.
TILE = 1024


def pairs_within(rows: DataFrame, group: list[str], item: str, carried: list[str], size: str | None = None, tile: int | None = None) -> DataFrame:
    """Every unordered pair of a group's rows once: group, item, carried and, with ``_b``, those of the other row.

    ``item`` is distinct in its group, and less than ``item_b``. A group of n rows is dealt
    by hash of the item to b = n / tile blocks, and every two blocks are a tile, told apart in the
    join's key: n ** 2 / 2 pairs are b ** 2 / 2 keys of equal size and so never one task's.
    For that its rows are sent b times; groups of up to ``tile`` rows are one tile, and are sent
    once. ``size`` names a column with the rows of the group; without it they are counted.
    """
    tile = TILE if tile is None else tile
    held = rows.select(*group, item, *carried, *([F.col(size).alias("__n")] if size else []))
    if size is None:
        # Only large groups are listed: at most one for ``tile`` rows of the table.
        large = held.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > tile)
        held = held.join(large, group, "left")
    blocks = F.greatest(F.ceil(F.coalesce("__n", F.lit(1)) / tile), F.lit(1))
    held = held.withColumn("__blocks", blocks.cast("int"))
    held = held.withColumn("__own", F.pmod(F.xxhash64(item), F.col("__blocks")).cast("int")).drop("__n")
    first = held.withColumn("__hi", F.explode(F.sequence("__own", F.col("__blocks") - 1))).withColumnRenamed("__own", "__lo").drop("__blocks")
    second = held.withColumn("__lo", F.explode(F.sequence(F.lit(0), F.col("__own")))).withColumnRenamed("__own", "__hi").drop("__blocks")
    second = second.withColumnsRenamed({c: f"{c}_b" for c in (item, *carried)})
    met = first.join(second, [*group, "__lo", "__hi"]).filter((F.col("__lo") < F.col("__hi")) | (F.col(item) < F.col(f"{item}_b")))
    # Between two blocks either row may have the lesser item.
    turned = F.col(item) > F.col(f"{item}_b")
    out = []
    for c in (item, *carried):
        out += [F.when(turned, F.col(f"{c}_b")).otherwise(F.col(c)).alias(c), F.when(turned, F.col(c)).otherwise(F.col(f"{c}_b")).alias(f"{c}_b")]
    return met.select(*group, *out)
