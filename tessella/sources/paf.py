"""Alignments of reads to contigs: PAF scans of the merge path and of the extract path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.text import ROW_ID, kept, scan_lines

LEAST_FIELDS = 12
#: What a line is stripped of at both ends, as by ``\\s`` of Java's expressions.
BLANKS = " \t\n\x0b\f\r"


#: Why a line is left out: fewer fields, or what should be an integer is none.
REASONS = ("fields", "integers")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    trimmed = F.btrim("value", F.lit(BLANKS))
    # A row of its own for the fields, as a filter on them would else split the line anew for each mention.
    return scan_lines(spark, path).select(ROW_ID, "value", F.explode(F.array(F.split(trimmed, "\t"))).alias("f"))


def _int(k: int):
    return F.trim(F.get("f", F.lit(k))).try_cast("long")


def _judged(rows: DataFrame, columns: dict, integers: tuple[str, ...]) -> DataFrame:
    """``columns`` of every line, its ``reason`` if it is left out, and then its ``value`` too."""
    held = rows.select(ROW_ID, "value", F.size("f").alias("n"), *[c.alias(n) for n, c in columns.items()])
    broken = F.greatest(*[F.col(c).isNull() for c in integers])
    reason = F.when(F.col("n") < LEAST_FIELDS, "fields").when(broken, "integers")
    held = held.withColumn("reason", reason)
    return held.select(ROW_ID, *columns, F.when(F.col("reason").isNotNull(), F.col("value")).alias("value"), "reason")


def _texts(**places: int) -> dict:
    return {n: F.get("f", F.lit(k)) for n, k in places.items()}


def scan_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Lines for merging: five integers must parse. Lines that are left out have a ``reason`` and their ``value``."""
    f = _texts(read=0, contig=5)
    columns = {"read": f["read"], "q_start": _int(2), "q_end": _int(3), "strand": F.substring(F.get("f", F.lit(4)), 1, 1), "contig": f["contig"], "t_start": _int(7), "t_end": _int(8), "mapq": _int(11)}
    return _judged(_fields(spark, path), columns, ("q_start", "q_end", "t_start", "t_end", "mapq"))


def scan_placements(spark: SparkSession, path: str) -> DataFrame:
    """Lines for extraction: only query end and quality must parse; the rest stays as text. Blank lines are no lines."""
    f = _texts(read=0, contig=5, t_len=6, t_start=7, t_end=8)
    columns = {"read": f["read"], "q_end": _int(3), "contig": f["contig"], "t_len": f["t_len"], "t_start": f["t_start"], "t_end": f["t_end"], "mapq": _int(11)}
    return _judged(_fields(spark, path).filter("f <> array('')"), columns, ("q_end", "mapq"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Rows for merging; lines that cannot be read are left out."""
    return kept(scan_alignments(spark, path))


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """Rows for extraction; lines that cannot be read are left out."""
    return kept(scan_placements(spark, path))
