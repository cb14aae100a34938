"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import words as W

#: Bytes in an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, a temporary folder of it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at a number of bytes, so long texts don't make large ones.  Holds for the session, as plans are
    run after they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What worker processes keep from task to task, as functions with a cache.
CACHES: list = []


def hand_back() -> None:
    W.forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache=None):
    """The function of a task, which drops what other operators' tasks have kept, and at its end hands the memory that
    it no longer uses back to the machine: Python workers go on from task to task, and an executor's limit counts
    what they hold."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in CACHES:
            if other is not cache:
                other.cache_clear()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


def frugally(run: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """The same for the function of a group or of two.  Spark counts the arguments of such a function, so it calls this
    instead of being wrapped."""
    for other in CACHES:
        other.cache_clear()
    try:
        return run(*tables)
    finally:
        hand_back()


class Shelf:
    """A folder of one run.  put() writes and reads again; drop() deletes what is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def place(self) -> str:
        self.n += 1
        return f"{self.path}/{self.n}"

    def put(self, df: DataFrame) -> DataFrame:
        at = self.place()
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._shelf_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(t._shelf_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
