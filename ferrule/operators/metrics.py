"""Recall at k, its report by segment, candidate ceilings and depth curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 50


def recall_per_query(predictions: DataFrame, truth: DataFrame, query: str, item: str, rank: str = "rank", k: int = K) -> DataFrame:
    """``query, recall``: the share of a query's true items among its first k distinct predictions.

    A query without predictions has 0; one that truth names with a null item only, so without any true item, null.
    """
    firsts = predictions.groupBy(query, item).agg(F.min(rank).alias("__r"))
    w = Window.partitionBy(query).orderBy("__r", item)
    hits = firsts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).select(query, item, F.lit(1).alias("__hit"))
    joined = truth.select(query, item).distinct().join(hits, [query, item], "left")
    return joined.groupBy(query).agg((F.sum(F.when(F.col(item).isNotNull(), F.coalesce("__hit", F.lit(0)))) / F.nullif(F.count(item), F.lit(0))).alias("recall"))


def recall_report(per_query: DataFrame, segments: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """``segment, value, n, recall``: over all queries, and for each value of each segment column."""
    rows = per_query.join(segments.select(query, *[F.col(c).cast("string").alias(c) for c in columns]), query)
    grouped = rows.groupingSets([[], *[[F.col(c)] for c in columns]], *[F.col(c) for c in columns])
    out = grouped.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("recall").alias("recall"))
    m = len(columns)
    every = (1 << m) - 1
    one = {c: every ^ (1 << (m - 1 - i)) for i, c in enumerate(columns)}
    name = reduce(lambda e, c: e.when(F.col("g") == one[c], c), columns, F.when(F.col("g") == every, "ALL"))
    value = reduce(lambda e, c: e.when(F.col("g") == one[c], F.col(c)), columns, F.when(F.col("g") == every, ""))
    return out.select(name.alias("segment"), value.alias("value"), "n", "recall").where("value is not null")


def ceiling(candidates: DataFrame, truth: DataFrame, query: str, item: str) -> DataFrame:
    """One row: the share of all true pairs that are among the candidates."""
    t = truth.select(query, item).distinct()
    c = candidates.select(query, item).distinct().withColumn("__in", F.lit(1))
    return t.join(c, [query, item], "left").agg(F.count("*").alias("n_true"), F.sum(F.coalesce("__in", F.lit(0))).alias("n_found"), F.avg(F.coalesce("__in", F.lit(0)).cast("double")).alias("ceiling"))


def depth_curve(ranked: DataFrame, truth: DataFrame, query: str, item: str, depths: list[int], rank: str = "rank") -> DataFrame:
    """``depth, found``: the share of true pairs that the list has within each depth."""
    t = truth.select(query, item).distinct().join(ranked.select(query, item, rank), [query, item], "left")
    parts = [F.avg(F.coalesce((F.col(rank) <= d).cast("double"), F.lit(0.0))).alias(str(d)) for d in depths]
    one = t.agg(*parts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"`{d}`").alias("found")) for d in depths])).alias("x")).select("x.depth", "x.found")


def misses(candidates: DataFrame, ranked: DataFrame, truth: DataFrame, query: str, item: str, k: int = K) -> DataFrame:
    """``cause, n`` of all true pairs: found, ranked too low, or no candidate at all."""
    return causes(candidates, ranked, truth, query, item, k).groupBy("cause").agg(F.count("*").alias("n"))


def causes(candidates: DataFrame, ranked: DataFrame, truth: DataFrame, query: str, item: str, k: int = K) -> DataFrame:
    """``query, item, cause`` of every true pair."""
    t = truth.select(query, item).distinct()
    c = candidates.select(query, item).distinct().withColumn("__c", F.lit(True))
    r = ranked.where(F.col("rank") <= k).select(query, item).distinct().withColumn("__r", F.lit(True))
    cause = F.when(F.col("__r"), "found").when(F.col("__c"), "ranked_low").otherwise("no_candidate")
    return t.join(c, [query, item], "left").join(r, [query, item], "left").select(query, item, cause.alias("cause"))
