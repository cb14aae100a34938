"""Candidate lists of a query and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import topk

N_LEXICAL, K, DEPTH, KNN_DEPTH = 40, 50, 500, 300


def members(scored: DataFrame, pools: DataFrame, items: DataFrame, queries: DataFrame, query: str, item: str, place: str, depth: int, lexical: bool) -> DataFrame:
    """``query, item, tier, key, pos``: everything that may be among a query's first ``depth`` items.

    ``scored (query, item, score)`` has the items with a score; ``pools (query, place, mult)`` the query's places;
    ``items (item, place, vid, tie, pos)`` the corpus; ``queries (query, f_vid)``.  The key is score * mult + tie, and
    mult is 1 outside of the pool.  Tiers of a lexical list: in the pool and let in by the filter, with a score; in the
    pool, with a score; with a score; in the pool and let in; all.  Of a dense list: in the pool and let in; in the pool;
    all.  The tier of all items is made only for queries whose other tiers hold fewer than ``depth`` items, and of it no
    more than the ``depth`` items that come first by their tie.
    """
    q = queries.select(query, "f_vid")
    let_in = (F.coalesce("f_vid", F.lit("")) == "") | F.coalesce(F.col("vid") == F.col("f_vid"), F.lit(False))
    anywhere = pools.select(query).distinct().withColumn("__has", F.lit(True))
    mult = pools.groupBy(query, place).agg(F.max("mult").alias("mult"))
    rows = scored.join(items, item).join(q, query).join(mult, [query, place], "left").join(anywhere, query, "left")
    # a query without any pool has all places as its pool
    inside = F.col("mult").isNotNull() | F.col("__has").isNull()
    tiers = F.when(inside & let_in, 0).when(inside, 1).otherwise(2)
    key = F.col("score") * F.coalesce("mult", F.lit(1.0)) + F.col("tie")
    first = rows.select(query, item, tiers.alias("tier"), F.round(key, 9).alias("key"), "pos")
    if not lexical:
        return first
    # items of the pool without a score, behind all that have one
    pooled = mult.join(items, place).join(q, query).join(scored.select(query, item), [query, item], "left_anti")
    pooled = pooled.where(let_in).select(query, item, F.lit(3).alias("tier"), F.round("tie", 9).alias("key"), "pos")
    near = first.unionByName(pooled)
    short = q.select(query).join(near.groupBy(query).agg(F.count("*").alias("n")), query, "left").where(F.coalesce("n", F.lit(0)) < depth).select(query)
    popular = items.orderBy(F.desc(F.round("tie", 9)), "pos").limit(2 * depth)  # more than any short list can still need
    rest = short.crossJoin(F.broadcast(popular)).select(query, item, F.lit(4).alias("tier"), F.round("tie", 9).alias("key"), "pos")
    return near.unionByName(rest)


def ranked(rows: DataFrame, query: str, item: str, depth: int = DEPTH, exclude: DataFrame | None = None) -> DataFrame:
    return topk.tiered_top_k(rows, query, item, "tier", "key", "pos", depth, exclude)


def base_hybrid(lexical: DataFrame, dense: DataFrame, query: str, item: str, quota: int = N_LEXICAL, k: int = K) -> DataFrame:
    """The first ``quota`` of the lexical list, filled up to k from the dense list's other items."""
    return topk.quota_fusion(lexical, dense, query, item, quota, k)


def union(lists: dict[str, DataFrame], query: str, item: str, depths: dict[str, int]) -> DataFrame:
    """``query, item`` of all lists, with ``rank_<list>`` from 0, or the list's depth where it has not the item."""
    parts = [df.select(query, item, *[(F.col("rank") - 1 if n == name else F.lit(None).cast("int")).alias(f"rank_{n}") for n in lists]) for name, df in lists.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(query, item).agg(*[F.coalesce(F.min(f"rank_{n}"), F.lit(depths[n])).alias(f"rank_{n}") for n in lists])
