"""Alignment operators: quality filter, merge per (read, contig), extraction of multi-contact reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.text import ROW_ID

MIN_QUALITY, MIN_MERGED, MIN_QUERY_END, MIN_CONTACTS = 60, 100, 100, 2


def quality_filter(alignments: DataFrame, min_quality: int = MIN_QUALITY) -> DataFrame:
    """Rows of ``min_quality`` or more, with the aligned length on the read."""
    return alignments.filter(F.col("mapq") >= min_quality).withColumn("length", F.col("q_end") - F.col("q_start"))


def reads_in_order(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """(read, seen): the reads of ``rows``, each with its first row's order, by which they are listed."""
    return rows.groupBy("read").agg(F.min(F.col(ROW_ID) if order is None else order).alias("seen"))


#: What a merged row has of its first one.
CARRIED = ("q_start", "q_end", "strand", "t_start", "t_end")


def merge(alignments: DataFrame, order: Column | None = None, min_length: int | None = MIN_MERGED, carried: tuple[str, ...] = CARRIED) -> DataFrame:
    """One row per (read, contig): lengths added up, all else from the first row in order.

    ``first`` is that row's order, by which the rows of a read are listed. Merged lengths
    under ``min_length`` are left out afterwards, none if it is None. ``carried`` names what is wanted of the first row.
    """
    order = F.col(ROW_ID) if order is None else order
    carried = [c for c in carried if c in alignments.columns]
    row = F.struct(order.alias("first"), *carried)
    grouped = alignments.groupBy("read", "contig").agg(F.sum("length").alias("length"), F.min(row).alias("r"))
    held = grouped if min_length is None else grouped.filter(F.col("length") >= min_length)
    return held.select("read", "contig", *[f"r.{c}" for c in carried], "length", "r.first")


def extract(placements: DataFrame, min_quality: int = MIN_QUALITY, min_query_end: int = MIN_QUERY_END, least: int = MIN_CONTACTS) -> DataFrame:
    """Placements good enough of reads that have ``least`` of them; the test is on the query's end."""
    good = placements.filter((F.col("q_end") >= min_query_end) & (F.col("mapq") >= min_quality))
    if least <= 1:
        return good
    # Counted before the shuffle; the join can split a read with very many rows.
    enough = good.groupBy("read").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("read")
    return good.join(enough, "read", "left_semi")


def contact_lists(extracted: DataFrame, order: Column | None = None) -> DataFrame:
    """(read, contacts, n_contacts): each read's placements in order."""
    order = F.col(ROW_ID) if order is None else order
    item = F.struct(order.alias("o"), F.struct("contig", "t_start", "t_end").alias("x"))
    held = extracted.groupBy("read").agg(F.array_sort(F.collect_list(item)).alias("c"))
    return held.select("read", F.transform("c", lambda c: c["x"]).alias("contacts"), F.size("c").cast("long").alias("n_contacts"))


def run_counts(alignments: DataFrame, merged: DataFrame) -> DataFrame:
    """Counters of a run in one row: rows read, reads, merged rows and reads that keep any."""
    a = alignments.agg(F.count("*").alias("alignments"), F.countDistinct("read").alias("reads"))
    m = merged.agg(F.count("*").alias("merged"), F.countDistinct("read").alias("kept_reads"))
    both = a.unionByName(m, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
