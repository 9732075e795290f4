"""Shared folders for tables that cut lineage."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Times as long as a garbage collection took until the next one: they take 5 % of the time at most, however large the heap.
REST = 20
_next_release = 0.0


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES, so that what
    an executor and its workers hold of long texts doesn't grow with their
    length; a lower bound stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one set up here where none is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage.  Only then does Spark let go of the
    broadcasts, statuses and shuffle files of finished jobs and does the heap
    shrink, which grows around them over many small jobs.  A collection isn't
    asked for again before REST times as long as it took."""
    global _next_release
    began = time.monotonic()
    if began >= _next_release:
        spark._jvm.System.gc()
        _next_release = time.monotonic() + REST * (time.monotonic() - began)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    Nothing needs the job that wrote them then, so what Spark holds of it is
    released.  Such tables stay, like Spark's checkpoints, for the owner of the
    folder to clear, unless ``scratch`` is open."""
    path = fresh_path(df.sparkSession, name)
    for paths in getattr(_open, "lists", []):
        paths.append(path)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that this thread stored within.  By then
    all that was derived from them has to be written elsewhere."""
    _open.lists = [*getattr(_open, "lists", []), []]
    try:
        yield
    finally:
        *_open.lists, paths = _open.lists
        for text in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
