"""The alignment stage over a growing folder of alignment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.alignments import MIN_QUALITY


def stream_lengths(spark: SparkSession, folder: str, min_quality: int = MIN_QUALITY) -> DataFrame:
    """(read, contig, length): aligned lengths added up as files arrive.

    A streaming scan has no order over files, so the coordinates of a "first" row are left
    to the batch merge; the sums equal its lengths before the least-length filter.
    """
    lines = spark.readStream.text(folder)
    f = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    rows = lines.select(f.alias("f")).filter(F.size("f") >= 12)
    number = {n: F.trim(F.col("f")[k]).try_cast("long") for n, k in (("q_start", 2), ("q_end", 3), ("t_start", 7), ("t_end", 8), ("mapq", 11))}
    parsed = rows.select(F.col("f")[0].alias("read"), F.col("f")[5].alias("contig"), *[v.alias(n) for n, v in number.items()]).dropna()
    good = parsed.filter(F.col("mapq") >= min_quality)
    return good.groupBy("read", "contig").agg(F.sum(F.col("q_end") - F.col("q_start")).alias("length"))


def start(lengths: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the running lengths in a table in memory, for tests and for looking at."""
    return lengths.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
