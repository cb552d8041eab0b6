"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to a Python worker; bounds its memory whatever the texts' lengths.
BATCH_BYTES = 2 << 20


def released() -> None:
    """Give a worker's free memory back, as workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as in rows.

    The bounds are settings of the session, read when the plan runs, so they stay set.
    """
    conf = df.sparkSession.conf
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    for key, value in wanted.items():
        conf.set(key, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        released()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of the driver sets one; any
    other raises, as its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file:///tmp/barweave-checkpoint-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: Folders written inside ``scratch``, innermost last.
_open: list[list[str]] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; the file system deletes it when the session's JVM ends, ``scratch`` earlier."""
    path = f"{shared_folder(spark)}/barweave/{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    if _open:
        _open[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end: for work whose result has been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            files, place = _file_system(spark, path)
            files.delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
