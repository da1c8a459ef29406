"""Cutting lineage through a table that every executor can read again."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: (session, path) of what has been written.
_WRITTEN: list[tuple[str, str]] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: By session: how many writes are under way, and the setting before the first of them.
_WRITING: dict[str, tuple[int, str | None]] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local master gets a temporary folder where it is unset: on a cluster executors
    would each write to a disk of their own, and reads would miss rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _LOCK:
        _WRITTEN.append((_session(spark), path))
    return path


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go once a write is done. The setting is put back when the session's last write ends."""
    key = _session(spark)
    with _LOCK:
        n, before = _WRITING.get(key, (0, spark.conf.get(_FREE, None)))
        _WRITING[key] = (n + 1, before)
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(key)
            if n > 1:
                _WRITING[key] = (n - 1, before)
            elif before is None:
                spark.conf.unset(_FREE)
            else:
                spark.conf.set(_FREE, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later plans start from the written files, so a lost executor costs a re-read and
    not a re-computation, and an expensive column is computed once however often it is used.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this session has materialised; call it once results are written.

    Returns their number. Frames that were built on them can't be read afterwards; those of
    other sessions stay.
    """
    jvm, hadoop, key = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _session(spark)
    with _LOCK:
        mine = [p for s, p in _WRITTEN if s == key]
        _WRITTEN[:] = [x for x in _WRITTEN if x[0] != key]
    for path in mine:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    return len(mine)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """``with steps(spark): ...`` deletes this session's tables at the end; write results inside."""
    try:
        yield
    finally:
        release(spark)
