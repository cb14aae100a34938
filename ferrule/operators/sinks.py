"""Sinks and caches: parquet, sorted text, JSON and pivoted CSV files, and tables that are filled where they lack rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Writes the table and gives it as it is read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_words(words: DataFrame, column: str, path: str) -> None:
    """A dictionary: its distinct words in order, a line each; files follow one another in order, too."""
    one = words.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    one.orderBy("value").write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "word")


def write_json(df: DataFrame, path: str) -> None:
    """The few rows of an aggregate as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_metadata(values: dict, spark: SparkSession, path: str) -> None:
    """One object, say how a split was made."""
    write_json(spark.createDataFrame([(json.dumps(values, sort_keys=True, ensure_ascii=False),)], "metadata string"), path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("metadata string").json(path).first()[0])


def report(rows: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each of ``row``, a column for each value of ``column``."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))


def write_csv(df: DataFrame, path: str) -> None:
    """The few rows of a report, in one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this version, made and written if it is not there yet."""
    at = f"{path.rstrip('/')}/{version}"
    return spark.read.parquet(at) if exists(spark, at) else write_parquet(make(), at)


class VectorCache:
    """Vectors by key, computed once: a folder of parts, each written whole or not seen."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str = "embedding"):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    def _parts(self) -> list[str]:
        fs = self.spark._jvm.org.apache.hadoop.fs
        at = fs.Path(self.path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        return sorted(p for p in (f"{self.path}/{s.getPath().getName()}" for s in system.listStatus(at)) if exists(self.spark, p))

    def stored(self) -> DataFrame | None:
        parts = self._parts()
        return self.spark.read.parquet(*parts).dropDuplicates([self.key]) if parts else None

    def missing(self, keys: DataFrame) -> DataFrame:
        """Of the keys, those without a vector; by an anti join, so that nothing is collected."""
        wanted, have = keys.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]), self.stored()
        return wanted if have is None else wanted.join(have.select(self.key), self.key, "left_anti")

    def ensure(self, keys: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The keys' rows with their vectors; ``encode`` is given the rows that lack one and gives ``key, vector``."""
        missing = self.missing(keys)
        if not missing.isEmpty():
            encode(missing).select(self.key, self.vector).write.parquet(f"{self.path}/part-{len(self._parts()):06d}")
        have = self.stored()
        return keys.withColumn(self.vector, F.lit(None).cast("array<double>")) if have is None else keys.join(have, self.key, "left")
