"""Line-based scans with an explicit order, and blocks of lines under a header line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Structs of (file, offset of the split, place in it) compare in input order.
ROW_ID = "row_id"


def scan_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(row_id, value): the lines of text files; row_id gives their order."""
    reader = spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    lines = reader.text(path)
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"),
    )
    return lines.select(order.alias(ROW_ID), "value")


def kept(scanned: DataFrame) -> DataFrame:
    """The rows of a scan that could be read."""
    return scanned.filter("reason is null").drop("reason", "value")


def rejected(scanned: DataFrame) -> DataFrame:
    """(row_id, value, reason): the lines of a scan that could not be read, as they stand, and why."""
    return scanned.filter("reason is not null").select(ROW_ID, "value", "reason")


def reasons(*names: str) -> dict[str, Column]:
    """Counts of rejected lines by reason, to be observed while a scan is written."""
    return {n: F.count(F.when(F.col("reason") == n, 1)) for n in names}


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``own``, the last header so far in its split, beside every line, as lines come in order."""
    last, split = None, None
    for batch in batches:
        file, at = batch.column("file"), batch.column("at")
        if not batch.num_rows:
            continue
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(at[1:], at[:-1]))
        ends = [*(i + 1 for i in pc.indices_nonzero(new).to_pylist()), batch.num_rows]
        own, begin = [], 0
        for end in ends:
            here = (file[begin].as_py(), at[begin].as_py())
            last, split = last if here == split else None, here
            opens = batch.column("opens")[begin:end].to_numpy(zero_copy_only=False)
            # Places of the last headers; 0 is what the batch before left.
            at_head = np.maximum.accumulate(np.where(opens, np.arange(1, end - begin + 1), 0))
            values = batch.column("value")[begin:end]
            filled = pa.concat_arrays([pa.array([last], values.type), values]).take(pa.array(at_head))
            last, begin = filled[-1].as_py(), end
            own.append(filled)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(own)], names=[*batch.schema.names, "own"])


def under_headers(lines: DataFrame, is_header, loose: bool = False) -> DataFrame:
    """(row_id, header, value): lines that are no headers, each with the header before it.

    ``lines`` are those of ``scan_lines``, or some of them, as scanned: a split's stand in one partition in order.
    So the running header of a split needs no shuffle; the last header of each split, one short
    row, is carried to the splits after it. Lines before the first header are dropped, or
    have a null one if ``loose``.
    """
    part = F.struct(f"{ROW_ID}.file", f"{ROW_ID}.at")
    opens = F.coalesce(is_header, F.lit(False))
    flat = lines.select(f"{ROW_ID}.file", f"{ROW_ID}.at", f"{ROW_ID}.n", "value", opens.alias("opens"))
    running = flat.mapInArrow(_headed, "file string, at long, n long, value string, opens boolean, own string")
    running = running.select(F.struct("file", "at", "n").alias(ROW_ID), "value", "opens", "own").withColumn("part", part)
    marked = lines.select(ROW_ID, part.alias("part"), F.when(opens, F.struct("value")).alias("h"))
    last = marked.groupBy("part").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col(ROW_ID))).alias("h"))
    # One row per input split.
    carried = last.select("part", F.last("h", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    out = running.join(F.broadcast(carried), "part").withColumn("header", F.coalesce("own", "carried.value"))
    return out.filter(~F.col("opens") & (F.lit(loose) | F.col("header").isNotNull())).select(ROW_ID, "header", "value")


def write_lines(lines: DataFrame, path: str, order: list | None = None) -> None:
    """Write the column ``value``, sorted over all files by ``order``."""
    sorted_ = lines.orderBy(*order) if order else lines
    sorted_.select("value").write.text(path)
