"""Readers and writers of the pipeline's intermediate text files.

Inside the library stages pass DataFrames; these exist to exchange files with other tools.
Readers scan a path and hand its lines (row_id, value) to a parser; writers return the lines
to give to ``write_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.sequences import float_text, two_decimals
from tessella.sources.text import ROW_ID, kept, scan_lines, under_headers


def _trimmed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("value <> ''")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return parse_merged(scan_lines(spark, path))


#: Why a line is left out: no header before it, a wrong number of fields, no number where one should be.
MERGED_REASONS, EXTRACTED_REASONS, HYPEREDGE_REASONS = ("header", "fields"), ("header", "fields", "integers"), ("odd", "number")


def scan_merged(lines: DataFrame) -> DataFrame:
    """As ``parse_merged``, with the lines that it leaves out: these have a ``reason`` and their ``value``."""
    rows = under_headers(_trimmed(lines), F.col("value").endswith(":"), True)
    held = rows.select(ROW_ID, F.expr("left(header, length(header) - 1)").alias("read"), "value", F.split("value", ",").alias("f"))
    names = ("q_start", "q_end", "t_start", "t_end", "length")
    places = (1, 2, 4, 5, 6)
    field = {k: F.get("f", F.lit(k)) for k in range(7)}
    reason = F.when(F.col("read").isNull(), "header").when(F.size("f") < 7, "fields")
    columns = [field[0].alias("contig"), field[3].alias("strand"), *[F.trim(field[k]).try_cast("double").alias(n) for n, k in zip(names, places, strict=True)]]
    return held.select(ROW_ID, "read", *columns, F.when(reason.isNotNull(), F.col("value")).alias("value"), reason.alias("reason"))


def parse_merged(lines: DataFrame) -> DataFrame:
    """Blocks ``read:`` of ``contig,q_start,q_end,strand,t_start,t_end,length``, 7 fields or more."""
    return kept(scan_merged(lines))


def read_extracted(spark: SparkSession, path: str) -> DataFrame:
    return parse_extracted(scan_lines(spark, path))


def scan_extracted(lines: DataFrame) -> DataFrame:
    """As ``parse_extracted``, with the lines that it leaves out: these have a ``reason`` and their ``value``."""
    rows = under_headers(_trimmed(lines), F.col("value").endswith(":") & (F.size(F.split("value", r"\s+")) == 1), True)
    held = rows.select(ROW_ID, F.expr("left(header, length(header) - 1)").alias("read"), "value", F.split("value", ",").alias("f"))
    field = {k: F.get("f", F.lit(k)) for k in range(4)}
    numbers = {n: F.trim(field[k]).try_cast("long") for n, k in (("t_len", 1), ("t_start", 2), ("t_end", 3))}
    broken = F.greatest(*[c.isNull() for c in numbers.values()])
    reason = F.when(F.col("read").isNull(), "header").when(F.size("f") != 5, "fields").when(broken, "integers")
    columns = [F.replace(field[0], F.lit(":"), F.lit("")).alias("contig"), *[c.alias(n) for n, c in numbers.items()]]
    return held.select(ROW_ID, "read", *columns, F.when(reason.isNotNull(), F.col("value")).alias("value"), reason.alias("reason"))


def parse_extracted(lines: DataFrame) -> DataFrame:
    """Blocks ``read:`` (one word) of ``contig,t_len,t_start,t_end,mapq``, five fields exactly."""
    return kept(scan_extracted(lines))


def read_hyperedges(spark: SparkSession, path: str) -> DataFrame:
    return parse_hyperedges(scan_lines(spark, path))


def scan_hyperedges(lines: DataFrame) -> DataFrame:
    """(row_id, p, value, reason): every line's array of (vertex, weight), or why it is left out, and then itself."""
    held = _trimmed(lines).select(ROW_ID, "value", F.split("value", r"\s+").alias("f"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("f") - 2, F.lit(0)), F.lit(2)),
        lambda i: F.struct(F.get("f", i).try_cast("long").alias("vertex"), F.get("f", i + 1).try_cast("double").alias("weight")),
    )
    held = held.select(ROW_ID, "value", F.size("f").alias("n"), pairs.alias("p"))
    good = F.forall("p", lambda x: x["vertex"].isNotNull() & x["weight"].isNotNull())
    reason = F.when(F.col("n") % 2 != 0, "odd").when(~good, "number")
    return held.select(ROW_ID, F.when(reason.isNull(), F.col("p")).alias("p"), F.when(reason.isNotNull(), F.col("value")).alias("value"), reason.alias("reason"))


def parse_hyperedges(lines: DataFrame) -> DataFrame:
    """(edge_id, pos, vertex, weight) of lines ``id w id w ...``.

    A line with an odd number of words, or one that is no number, is left out whole. Of a
    vertex named twice the first place and the last weight stay.
    """
    return hyperedges_of(scan_hyperedges(lines))


def hyperedges_of(scanned: DataFrame) -> DataFrame:
    """The vertices of the lines of ``scan_hyperedges`` that could be read."""
    long = kept(scanned).select(F.col(ROW_ID).alias("edge_id"), F.posexplode("p").alias("pos", "x")).select("edge_id", "pos", "x.*")
    return long.groupBy("edge_id", "vertex").agg(F.max_by("weight", "pos").alias("weight"), F.min("pos").alias("pos"))


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    return parse_partitions(scan_lines(spark, path))


def parse_partitions(lines: DataFrame) -> DataFrame:
    """(partition, vertex, pos) of lines ``label: v v ...``; two colons in a line are an error."""
    lines = _trimmed(lines).filter(F.contains("value", F.lit(":")))
    checked = lines.withColumn("f", F.split("value", ":"))
    checked = checked.withColumn("f", F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not one colon in: "), "value")).cast("array<string>")))
    long = checked.select(F.trim(F.col("f")[0]).alias("partition"), ROW_ID, F.posexplode(F.split(F.trim(F.col("f")[1]), r"\s+")).alias("pos", "vertex"))
    return long.filter("vertex <> ''")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return parse_weights(scan_lines(spark, path))


def parse_weights(lines: DataFrame) -> DataFrame:
    """(a, b, weight) of lines ``a b weight`` with a positive weight."""
    f = F.split("value", r"\s+")
    rows = _trimmed(lines).select(f.alias("f"))
    out = rows.select(F.get("f", F.lit(0)).try_cast("long").alias("a"), F.get("f", F.lit(1)).try_cast("long").alias("b"), F.get("f", F.lit(2)).try_cast("double").alias("weight"))
    return out.filter("weight > 0")


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    return parse_chains(scan_lines(spark, path))


def parse_chains(lines: DataFrame) -> DataFrame:
    """(row_id, chain, pos, endpoint) of lines ``name: ep ep ...``; other lines are left out."""
    lines = _trimmed(lines).withColumn("f", F.split("value", ": ")).filter(F.size("f") == 2)
    return lines.select(ROW_ID, F.col("f")[0].alias("chain"), F.posexplode(F.split(F.trim(F.col("f")[1]), r"\s+")).alias("pos", "endpoint"))


def merged_lines(merged: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads`` with a value each: its header, also where no row is left, and its rows in order.

    ``reads`` are those of the good alignments, as of ``alignments.reads_in_order``; a read that
    has none is not written.
    """
    rows = merged.groupBy("read").agg(_blocks(F.lit(True)))
    return _under_reads(reads.join(rows, "read", "left"), reads.columns)


def merged_blocks(merged: DataFrame, min_length: int) -> DataFrame:
    """(read, seen, value) as of ``merged_lines``, from the merged rows of any length of all good alignments.

    Rows of ``min_length`` or more are written; ``seen`` is the least ``first`` of a read, by which blocks are ordered.
    """
    return _under_reads(merged.groupBy("read").agg(_blocks(F.col("length") >= min_length), F.min("first").alias("seen")), ["read", "seen"])


def _blocks(wanted: Column) -> Column:
    row = F.concat_ws(",", "contig", "q_start", "q_end", "strand", "t_start", "t_end", "length")
    return F.sort_array(F.collect_list(F.when(wanted, F.struct("first", row.alias("row"))))).alias("rows")


def _under_reads(held: DataFrame, columns: list[str]) -> DataFrame:
    body = F.coalesce(F.transform("rows", lambda r: r["row"]), F.array().cast("array<string>"))
    return held.select(*columns, F.array_join(F.concat(F.array(F.concat("read", F.lit(":"))), body), "\n").alias("value"))


def extracted_lines(extracted: DataFrame) -> DataFrame:
    """(read, seen, value): blocks of rows; ``seen`` is the first row's place, by which blocks are ordered."""
    row = F.concat_ws(",", "contig", "t_len", "t_start", "t_end", "mapq")
    rows = extracted.groupBy("read").agg(F.array_sort(F.collect_list(F.struct(ROW_ID, row.alias("row")))).alias("rows"), F.min(ROW_ID).alias("seen"))
    return rows.select("read", "seen", F.concat("read", F.lit(":\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n")).alias("value"))


def hyperedge_lines(entries: DataFrame) -> DataFrame:
    """(read[, line], value): ``id w id w ...`` per read with entries, from (read, pos, vertex, weight[, line]).

    Names without a number are written as they are; whoever reads the line leaves it out whole.
    """
    entry = F.struct("pos", F.concat_ws(" ", F.col("vertex").cast("string"), F.col("weight").cast("long").cast("string")).alias("e"))
    line = [F.min("line").alias("line")] if "line" in entries.columns else []
    rows = entries.groupBy("read").agg(F.array_sort(F.collect_list(entry)).alias("rows"), *line)
    return rows.select("read", *(["line"] if line else []), F.array_join(F.transform("rows", lambda r: r["e"]), " ").alias("value"))


def community_lines(communities: DataFrame) -> DataFrame:
    rows = communities.groupBy("label").agg(F.array_sort(F.collect_list("vertex")).alias("vs"))
    return rows.select("label", F.concat(F.col("label").cast("string"), F.lit(": "), F.array_join(F.transform("vs", lambda v: v.cast("string")), " ")).alias("value"))


def chain_lines(chains: DataFrame) -> DataFrame:
    """``partition_k: ep ep ...`` from (partition, chain_no, pos, endpoint)."""
    rows = chains.groupBy("partition", "chain_no").agg(F.array_sort(F.collect_list(F.struct("pos", "endpoint"))).alias("rows"))
    name = F.concat_ws("_", F.col("partition").cast("string"), F.col("chain_no").cast("string"))
    return rows.select("partition", "chain_no", F.concat(name, F.lit(": "), F.array_join(F.transform("rows", lambda r: r["endpoint"]), " ")).alias("value"))


def weight_lines(weights: DataFrame) -> DataFrame:
    """``a b weight`` with two decimals, half to even on the exact binary value."""
    return weights.select("a", "b", F.concat_ws(" ", "a", "b", two_decimals(F.col("weight").cast("double"))).alias("value"))


def adjacency_lines(adjacency: DataFrame) -> DataFrame:
    return adjacency.select("v", "rank", F.concat_ws(" ", F.col("v").cast("string"), F.col("neighbor").cast("string"), float_text(F.col("weight").cast("double"))).alias("value"))
