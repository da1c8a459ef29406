"""FASTA records, one row each, and the FASTA sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.sequences import wrap
from tessella.sources.text import ROW_ID, scan_lines, write_lines


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, name, header, seq, length) per record, in file order by row_id.

    A record ends where a line begins with ``>``. Carriage returns are removed, and so is
    text before the first header. name is the first word of the header. Only line ends are
    taken out of a sequence, so trailing blanks count. A bare ``>`` has an empty name.
    """
    chunks = scan_lines(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "\r", ""))
    first = chunks.groupBy(F.col(f"{ROW_ID}.file").alias("file")).agg(F.min(ROW_ID).alias("first"))
    # One row per file.
    held = chunks.join(first, F.col(f"{ROW_ID}.file") == F.col("file"))
    opens = F.col(ROW_ID) == F.col("first")
    held = held.filter(~opens | F.col("value").startswith(">"))
    body = F.when(opens, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    cut = held.select(ROW_ID, body.alias("body"))
    header = F.substring_index("body", "\n", 1)
    seq = F.replace(F.substr("body", F.length(header) + 2), F.lit("\n"), F.lit(""))
    parsed = cut.select(ROW_ID, F.regexp_extract(F.trim(header), r"^(\S*)", 1).alias("name"), header.alias("header"), seq.alias("seq"))
    return parsed.withColumn("length", F.length("seq").cast("long"))


def read_fasta_chunks(spark: SparkSession, path: str, bases: bool = True) -> DataFrame:
    """(row_id, name, header, at, bases): the lines of each record with their offsets in it, and an empty row per record.

    As ``read_fasta``, for records of any length; row_id is the record's. Offsets are running
    sums inside each input split; what a record has in the splits before is carried on, one
    short row for each split. Without ``bases`` rows have their number as ``n`` instead, and no text is sorted.
    """
    lines = scan_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r", ""))
    opens = F.col("value").startswith(">")
    n = F.when(opens, 0).otherwise(F.length("value")).cast("long")
    split, place = F.col(f"{ROW_ID}.at").alias("split"), F.col(f"{ROW_ID}.n").alias("place")
    head = F.when(opens, F.struct(split, place, F.col("value").alias("text"))).alias("head")
    held = lines.select(F.col(f"{ROW_ID}.file").alias("file"), split, place, n.alias("n"), head, *([F.when(~opens, F.col("value")).alias("line")] if bases else []))
    inside = Window.partitionBy("file", "split").orderBy("place")
    held = held.withColumn("before", F.sum("n").over(inside) - F.col("n"))
    held = held.withColumn("own", F.last(F.when(F.col("head").isNotNull(), F.struct("head", "before")), True).over(inside))
    per = held.groupBy("file", "split").agg(F.sum("n").alias("all"), F.max_by("own", "place").alias("last"))
    # One row per input split, file by file.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start", F.coalesce(F.sum("all").over(earlier), F.lit(0).cast("long")))
    head = F.when(F.col("last").isNotNull(), F.struct(F.col("last.head").alias("head"), (F.col("start") + F.col("last.before")).alias("before")))
    per = per.select("file", "split", "start", F.last(head, True).over(earlier).alias("carried"))
    both = held.join(per, ["file", "split"])
    head = F.coalesce("own.head", "carried.head")
    at = F.when(F.col("own").isNotNull(), F.col("before") - F.col("own.before")).otherwise(F.col("start") + F.col("before") - F.col("carried.before"))
    text = F.substr(head["text"], F.lit(2))
    row_id = F.struct(F.col("file"), head["split"].alias("at"), head["place"].alias("n"))
    own = F.coalesce("line", F.lit("")).alias("bases") if bases else F.col("n")
    return both.filter(head.isNotNull()).select(row_id.alias(ROW_ID), F.regexp_extract(F.trim(text), r"^(\S*)", 1).alias("name"), text.alias("header"), at.alias("at"), own)


def records(chunks: DataFrame) -> DataFrame:
    """(row_id, name, header, length) of the records in rows of ``read_fasta_chunks``."""
    n = F.col("n") if "n" in chunks.columns else F.length("bases").cast("long")
    return chunks.groupBy(ROW_ID).agg(F.first("name").alias("name"), F.first("header").alias("header"), F.sum(n).alias("length"))


def last_chunks(chunks: DataFrame) -> DataFrame:
    """(name, at, bases) of the last record of each name."""
    heads = chunks.filter("at = 0 and bases = ''")
    last = heads.groupBy("name").agg(F.max(ROW_ID).alias(ROW_ID)).select(ROW_ID)
    return chunks.join(last, ROW_ID, "left_semi").select("name", "at", "bases")


def last_of_each_name(records: DataFrame) -> DataFrame:
    """One row per name: the place of its first record, the content of its last."""
    own = [c for c in records.columns if c not in ("name", ROW_ID)]
    kept = records.groupBy("name").agg(F.min(ROW_ID).alias(ROW_ID), F.max_by(F.struct(*own), ROW_ID).alias("r"))
    return kept.select(ROW_ID, "name", "r.*")


def length_lines(records: DataFrame) -> DataFrame:
    """``>name`` and the length under it, as lines to write."""
    return records.select(ROW_ID, F.concat(F.lit(">"), "name", F.lit("\n"), F.col("length").cast("string")).alias("value"))


def scaffold_lines(scaffolds: DataFrame, width: int = 80) -> DataFrame:
    """``>scaffoldN`` and the sequence in lines of ``width``, from (no, seq)."""
    return scaffolds.select("no", F.concat(F.lit(">scaffold"), F.col("no").cast("string"), F.lit("\n"), wrap(F.col("seq"), width)).alias("value"))


def renamed(records: DataFrame, prefix: str = "chr1_contig_") -> DataFrame:
    """Records named prefix1, prefix2, ... in file order, sequences in upper case.

    The number is the count of records in the splits before plus the place in its own
    split, so no task sees all records.
    """
    part: Column = F.struct(f"{ROW_ID}.file", f"{ROW_ID}.at")
    held = records.withColumn("part", part)
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    # One row per input split.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(ROW_ID))
    out = held.withColumn("place", place).join(before, "part")
    return out.select(ROW_ID, F.concat(F.lit(prefix), (F.col("before") + F.col("place")).cast("string")).alias("name"), F.upper("seq").alias("seq"))


def block_lines(blocks: DataFrame, width: int = 80) -> DataFrame:
    """(no, block, value): ``>scaffoldN`` and lines of ``width``, from blocks of a multiple of it."""
    head = F.when(F.col("block") == 0, F.concat(F.lit(">scaffold"), F.col("no").cast("string"), F.lit("\n"))).otherwise("")
    return blocks.select("no", "block", F.concat(head, wrap(F.col("bases"), width)).alias("value"))


def write_fasta(blocks: DataFrame, path: str) -> None:
    """Scaffolds in blocks (no, block, bases) as one text in order; no value is longer than a block."""
    write_lines(block_lines(blocks), path, ["no", "block"])
