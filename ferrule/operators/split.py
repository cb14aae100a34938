"""Hold-out splits by strata, leak-free statistics and training samples.

Random choices are orders by a hash of a seed and the row's keys: the same in every run, whatever the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import right_closed
from .topk import hash_order

# The upper edges of the bins and their names.
FREQUENCY = ([0, 1, 3, 10, 100], ["0", "1", "2-3", "4-10", "11-100", ">100"])
POOL = ([300, 1000, 3000, 10000], ["<=300", "301-1000", "1001-3000", "3001-10000", ">10000"])
STRATA = ["freq_bucket", "loc_level", "has_vid", "pool_bucket"]


def frequency_bucket(rows: Column) -> Column:
    return right_closed(rows, *FREQUENCY)


def pool_bucket(size: Column) -> Column:
    return right_closed(size, *POOL)


def other_sessions(queries: DataFrame, pairs: DataFrame, query: str, text: str) -> DataFrame:
    """queries with ``freq_bucket`` by the choices of the same text in other sessions: a text of one session has none."""
    own = pairs.groupBy(query).agg(F.sum("n_choices").alias("__own"))
    rows = queries.join(own, query, "left").withColumn("__own", F.coalesce("__own", F.lit(0)))
    others = F.sum("__own").over(Window.partitionBy(text)) - F.col("__own")
    return rows.withColumn("other_choices", others).withColumn("freq_bucket", frequency_bucket(F.col("other_choices"))).drop("__own")


def targets(benchmark: DataFrame, strata: list[str], n: int) -> DataFrame:
    """``strata, target``: the benchmark's shares of n, rounded half to even."""
    counts = benchmark.groupBy(*strata).agg(F.count("*").alias("__c"))
    total = F.sum("__c").over(Window.partitionBy(F.lit(1)))  # a row a stratum
    return counts.withColumn("target", F.bround(F.lit(float(n)) * F.col("__c") / total).cast("long")).drop("__c")


def stratified_pick(pool: DataFrame, targets: DataFrame, strata: list[str], query: str, text: str, seed: int) -> DataFrame:
    """Up to the target of queries of each stratum, no text twice; rarer strata choose first.

    As targets are rounded stratum by stratum, their sum can differ from the number asked for by a few.

    Rounds in which all strata pick at once: a text that several pick goes to the rarest of them, and the others pick
    again without it, until no text is picked twice.  As all texts prefer rarer strata, this ends as choosing stratum by
    stratum does.  What a round collects is at most the sum of the targets.
    """
    spark = pool.sparkSession
    sizes = pool.groupBy(*strata).agg(F.count("*").alias("__size")).withColumn("__o", F.row_number().over(Window.orderBy("__size", *strata)))  # a row a stratum
    rows = pool.join(sizes.drop("__size"), strata).join(targets, strata).withColumn("__h", hash_order(seed, query))
    once = Window.partitionBy("__o", text).orderBy("__h", query)
    rows = rows.withColumn("__t", F.row_number().over(once)).where("__t = 1").drop("__t")
    pick = Window.partitionBy("__o").orderBy("__h", query)
    lost: list = []
    kind = f"__o int, `{text}` {pool.schema[text].dataType.simpleString()}"
    while True:
        left = rows.join(spark.createDataFrame(lost, kind), ["__o", text], "left_anti") if lost else rows
        picked = left.withColumn("__n", F.row_number().over(pick)).where("__n <= target").drop("__n")
        twice = picked.select("__o", text).withColumn("__first", F.min("__o").over(Window.partitionBy(text))).where("__o > __first").drop("__first").collect()
        if not twice:
            return picked.select(*pool.columns)
        lost += twice


def native_only(pairs: DataFrame, corpus: DataFrame, query: str, item: str) -> DataFrame:
    """``query`` of the sessions whose chosen items are all in the corpus."""
    known = corpus.select(item).distinct().withColumn("__in", F.lit(True))
    return pairs.join(known, item, "left").groupBy(query).agg(F.min(F.coalesce("__in", F.lit(False))).alias("all_in")).where("all_in").select(query)


def exclude(queries: DataFrame, earlier: list[DataFrame], query: str, text: str | None = None) -> DataFrame:
    """queries that earlier splits don't have; with ``text``, whose text they don't have either."""
    for e in earlier:
        queries = queries.join(e.select(query), query, "left_anti")
        if text:
            queries = queries.join(e.select(text).distinct(), text, "left_anti")
    return queries


def evaluation_corpus(corpus: DataFrame, held_out: DataFrame, item: str) -> DataFrame:
    return corpus.select(item).union(held_out.select(item)).distinct()


@dataclass
class Split:
    """A hold-out split: the held-out queries and pairs, and the fit part without them."""

    val_queries: DataFrame
    val_pairs: DataFrame
    fit_queries: DataFrame
    fit_pairs: DataFrame
    corpus: DataFrame


def load(queries: DataFrame, pairs: DataFrame, held: DataFrame, corpus: DataFrame, query: str, item: str) -> Split:
    val_pairs = pairs.join(held.select(query), query, "left_semi")
    return Split(queries.join(held.select(query), query, "left_semi"), val_pairs, queries.join(held.select(query), query, "left_anti"), pairs.join(held.select(query), query, "left_anti"), evaluation_corpus(corpus, val_pairs, item))


def diagnostics(picked: DataFrame, targets: DataFrame, strata: list[str]) -> DataFrame:
    """``strata, target, n, shortfall``."""
    got = picked.groupBy(*strata).agg(F.count("*").alias("n"))
    out = targets.join(got, strata, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("shortfall", F.greatest(F.col("target") - F.col("n"), F.lit(0)))


def negatives(pairs: DataFrame, query: str, item: str, label: str, n: int = 100, seed: int = 13, need_positive: bool = False) -> DataFrame:
    """All positives and, of each query, the n negatives that are first by hash; with need_positive, only of queries that have one."""
    rows = pairs
    if need_positive:
        rows = rows.withColumn("__p", F.max(label).over(Window.partitionBy(query))).where("__p > 0").drop("__p")
    w = Window.partitionBy(query, label).orderBy(hash_order(seed, query, item), item)
    return rows.withColumn("__n", F.row_number().over(w)).where((F.col(label) > 0) | (F.col("__n") <= n)).drop("__n")


def batches(pairs: DataFrame, text: str, item: str, category: str, size: int, seed: int, least: int = 8) -> DataFrame:
    """``half, batch`` of contrastive pairs: half of them in order of category, half at random; no text and no item twice
    in a batch, and no batch with fewer than ``least`` pairs.

    Places in the order are counted by parts, of a category and the first digits of the hash, so no task sorts a half.
    """
    rows = pairs.withColumn("__h", hash_order(seed, text, item))
    rows = rows.withColumn("half", F.when(F.substring("__h", 32, 1) < "8", 0).otherwise(1))
    rows = rows.withColumn("__c", F.when(F.col("half") == 0, F.coalesce(F.col(category).cast("string"), F.lit(""))).otherwise("")).withColumn("__b", F.substring("__h", 1, 2))
    part = ["half", "__c", "__b"]
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("half").orderBy("__c", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(*part).agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")  # a row a part
    place = F.row_number().over(Window.partitionBy(*part).orderBy("__h", text, item)) - 1
    rows = rows.withColumn("__at", place).join(parts, part).withColumn("batch", F.floor((F.col("__before") + F.col("__at")) / size))
    for once in (text, item):
        w = Window.partitionBy("half", "batch", once).orderBy("__h", text, item)
        rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("half", "batch"))).where(F.col("__n") >= least)
    return rows.select(*pairs.columns, "half", "batch")
