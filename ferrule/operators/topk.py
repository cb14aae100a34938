"""Selections by rank within a query.

All orders are total: key descending, then ``pos`` ascending.  Spark limits each group before it shuffles where a
rank is filtered right above its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def top_k(df: DataFrame, by: str | list[str], score: str, pos: str, k: int, rank: str = "rank") -> DataFrame:
    """The k rows of each group with the largest score, with their rank from 1."""
    w = Window.partitionBy(*_names(by)).orderBy(F.desc(score), F.asc(pos))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, key: str | list[str], pos: str | list[str]) -> DataFrame:
    """The first row of each key, in the order of ``pos``."""
    w = Window.partitionBy(*_names(key)).orderBy(*_names(pos))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tiered_top_k(members: DataFrame, by: str, item: str, tier: str, key: str, pos: str, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """The k items of each query that fill the tiers in order, with ``rank`` from 1.

    ``members`` has a row for each (query, item, tier); an item in several tiers counts for the first of them.  Within
    a tier the order is key descending, pos ascending.  ``exclude (by, item)`` is taken out before.
    """
    if exclude is not None:
        members = members.join(exclude.select(by, item).distinct(), [by, item], "left_anti")
    best = members.groupBy(by, item).agg(F.min(tier).alias(tier), F.max(key).alias(key), F.min(pos).alias(pos))
    w = Window.partitionBy(by).orderBy(F.asc(tier), F.desc(key), F.asc(pos))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quota_fusion(first: DataFrame, second: DataFrame, by: str, item: str, quota: int, k: int) -> DataFrame:
    """``by, item, rank``: the first ``quota`` of one ranked list, then the other's items that are not among them."""
    head = first.where(F.col("rank") <= quota).select(by, item, F.lit(0).alias("__part"), "rank")
    rest = second.join(head.select(by, item), [by, item], "left_anti").select(by, item, F.lit(1).alias("__part"), "rank")
    w = Window.partitionBy(by).orderBy("__part", "rank", item)
    return head.unionByName(rest).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(by, item, F.col("r").alias("rank"))


def fill_up(ranked: DataFrame, base: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """Up to k items a query: those of ``ranked`` in order, then those of ``base`` that are not there yet."""
    every = ranked.select(by, item, F.lit(0).alias("__part"), "rank").unionByName(base.select(by, item, F.lit(1).alias("__part"), "rank"))
    best = every.groupBy(by, item).agg(F.min(F.struct("__part", "rank")).alias("at"))
    w = Window.partitionBy(by).orderBy("at.__part", "at.rank", item)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, item, "rank")


def reciprocal_rank_fusion(lists: list[DataFrame], by: str, item: str, k: int, constant: int = 60) -> DataFrame:
    """``by, item, score, rank`` by the sum of 1 / (constant + rank) over the lists."""
    every = lists[0].select(by, item, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(by, item, "rank"))
    # the ranks are added in order, so that the sum is the same wherever the rows were
    fused = every.groupBy(by, item).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    total = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + 1 / (constant + r))
    return top_k(fused.select(by, item, F.round(total, 9).alias("score")), by, "score", item, k)


def average_rank(value: str, by: str | list[str]) -> Column:
    """Rank from 1 within the group, descending; equal values share the mean of their ranks."""
    w = Window.partitionBy(*_names(by))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*_names(by), value))
    return F.rank().over(w.orderBy(F.desc(value))) + (ties - 1) / 2.0


def gap_to_max(value: str, by: str | list[str]) -> Column:
    return F.col(value) - F.max(value).over(Window.partitionBy(*_names(by)))


def ratio_to_max(value: str, by: str | list[str], least: float = 1e-6) -> Column:
    return F.col(value) / F.greatest(F.max(value).over(Window.partitionBy(*_names(by))), F.lit(least))


def share(value: str, by: str | list[str]) -> Column:
    """The value as a share of its group's sum."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(*_names(by)))


def sum_before(value: str, by: str | list[str], order: list[Column]) -> Column:
    """The sum over the rows before this one."""
    w = Window.partitionBy(*_names(by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def hash_order(seed: int, *columns: str) -> Column:
    """A pseudo-random order that is the same in every run, whatever the partitions, and in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def rank_band(df: DataFrame, by: str, score: str, pos: str, first: int, last: int, pick: Column) -> DataFrame:
    """Of the rows with ranks from ``first`` to ``last`` in each group, the one that is least by ``pick``."""
    ranked = top_k(df, by, score, pos, last).where(F.col("rank") >= first)
    w = Window.partitionBy(by).orderBy(pick, pos)
    return ranked.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
