"""Analyses of queries, pools, fields and lists, and the variants of ranking that were compared with them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import topk


def concentration(rows: DataFrame, query: str, category: str, n: str, tops: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row: the mean share of a query's choices that its most chosen categories have, ``top_<k>`` for each k."""
    by = rows.groupBy(query, category).agg(F.sum(n).alias("c"))
    ranked = by.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("c"), category)))
    shares = ranked.groupBy(query).agg(*[(F.sum(F.when(F.col("r") <= k, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"top_{k}") for k in tops])
    return shares.agg(*[F.avg(f"top_{k}").alias(f"top_{k}") for k in tops])


def items_per_session(pairs: DataFrame, query: str) -> DataFrame:
    """``n_relevant, sessions``: how many sessions have so many relevant items."""
    return pairs.groupBy(query).agg(F.count("*").alias("n_relevant")).groupBy("n_relevant").agg(F.count("*").alias("sessions"))


def session_means(pairs: DataFrame, query: str) -> DataFrame:
    """One row: the mean number of a session's relevant items, and the mean of its inverse, which recall is weighted by."""
    by = items_per_session(pairs, query)
    n = F.sum("sessions")
    return by.agg((F.sum(F.col("n_relevant") * F.col("sessions")) / n).alias("mean"), (F.sum(F.col("sessions") / F.col("n_relevant")) / n).alias("mean_inverse"))


def quantiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.1, 0.5, 0.9), small: float = 50) -> DataFrame:
    """``by, p10, p50, p90, share_small``: exact quantiles of the value in each group, and the share up to ``small``."""
    parts = [F.percentile(value, p).alias(f"p{round(100 * p)}") for p in at]
    return rows.groupBy(*by).agg(*parts, F.avg((F.col(value) <= small).cast("double")).alias("share_small"))


def word_coverage(queries: DataFrame, query: str, words: str, docs: DataFrame, fields: list[str], prefix: int | None = None) -> DataFrame:
    """``field, found, none, all, only``: of queries with words, the mean share of distinct words that the chosen document
    has in the field, the shares of queries with none and with all of them, and the mean share that only this field has.

    ``docs (query, *fields)`` has the document chosen for a query, its fields as arrays of words.  With ``prefix``, words
    count by their first letters.
    """
    cut = (lambda c: F.transform(c, lambda w: F.substring(w, 1, prefix))) if prefix else (lambda c: c)
    rows = queries.select(query, F.array_distinct(cut(F.col(words))).alias("__w")).where(F.size("__w") > 0).join(docs.select(query, *fields), query)
    n = F.size("__w")
    rows = rows.withColumns({f"__{f}": F.array_intersect("__w", cut(F.coalesce(F.col(f), F.array().cast("array<string>")))) for f in fields})

    def one(f: str) -> Column:
        others = reduce(F.array_union, [F.col(f"__{g}") for g in fields if g != f], F.array().cast("array<string>"))
        has = F.size(f"__{f}")
        return F.struct(
            F.lit(f).alias("field"),
            (has / n).alias("found"),
            (has == 0).cast("double").alias("none"),
            (has == n).cast("double").alias("all"),
            (F.size(F.array_except(F.col(f"__{f}"), others)) / n).alias("only"),
        )

    long = rows.select(F.explode(F.array(*map(one, fields))).alias("x")).select("x.*")
    return long.groupBy("field").agg(*[F.avg(c).alias(c) for c in ("found", "none", "all", "only")])


def agreement(pairs: DataFrame, filters: dict[str, str]) -> DataFrame:
    """``filter, asked, agreed``: of pairs that ask for a value, how many there are and the share whose item has it."""
    asked = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) != "" for f in filters}
    parts = [F.struct(F.lit(f).alias("filter"), asked[f].alias("asks"), F.coalesce(F.col(f) == F.col(of), F.lit(False)).alias("has")) for f, of in filters.items()]
    long = pairs.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("asks")
    return long.groupBy("filter").agg(F.count("*").alias("asked"), F.avg(F.col("has").cast("double")).alias("agreed"))


def shares(rows: DataFrame, markers: list[str], by: list[str] | None = None) -> DataFrame:
    """The share of rows on which each marker is set, over all rows or for each group."""
    return rows.groupBy(*(by or [])).agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in markers])


def drift(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, first, second, shift``: the share of each value of each column in two tables, and the difference."""

    def of(df: DataFrame, name: str) -> DataFrame:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])).alias("x")).select("x.*")
        total = F.sum("n").over(Window.partitionBy("column"))  # a row a value
        return long.groupBy("column", "value").agg(F.count("*").alias("n")).select("column", "value", (F.col("n") / total).alias(name))

    both = of(first, "first").join(of(second, "second"), ["column", "value"], "full").fillna(0.0, ["first", "second"])
    return both.withColumn("shift", F.col("second") - F.col("first"))


def calibration(points: DataFrame, local: str, platform: str) -> DataFrame:
    """One row: ``slope, intercept`` of the line that leads from local to platform figures."""
    return points.agg(F.regr_slope(platform, local).alias("slope"), F.regr_intercept(platform, local).alias("intercept"))


def reweighted(per_query: DataFrame, shares: DataFrame, strata: list[str], value: str = "recall", share: str = "share") -> DataFrame:
    """One row: the mean of the strata's means, weighted by the given shares; strata without queries weigh nothing."""
    means = per_query.groupBy(*strata).agg(F.avg(value).alias("__m"))
    return means.join(shares.select(*strata, share), strata).agg((F.sum(F.col("__m") * F.col(share)) / F.sum(share)).alias(value))


def hard_corpus(corpus: DataFrame, near: DataFrame, item: str, m: int, rank: str = "rank") -> DataFrame:
    """``item``: the corpus and each query's m nearest others, which make it harder."""
    return corpus.select(item).union(near.where(F.col(rank) <= m).select(item)).distinct()


def boosted(scored: DataFrame, toponyms: str, address: str, factor: float, score: str = "score") -> DataFrame:
    """scored, with the score times a factor where the address has one of the query's toponyms."""
    return scored.withColumn(score, F.col(score) * F.when(F.arrays_overlap(toponyms, address), factor).otherwise(1.0))


def outside_categories(scored: DataFrame, covering: DataFrame, query: str, category: str, factor: float, score: str = "score") -> DataFrame:
    """scored, with the score times a factor where the category is not in the query's covering set."""
    inside = covering.select(query, category).distinct().withColumn("__in", F.lit(True))
    return scored.join(inside, [query, category], "left").withColumn(score, F.col(score) * F.when(F.col("__in"), 1.0).otherwise(factor)).drop("__in")


def service_tier(members: DataFrame, asked: str, has: str, tier: str = "tier") -> DataFrame:
    """members with twice as many tiers: within each, items of the type that is asked for come first."""
    wanted = (F.coalesce(asked, F.lit("")) == "") | F.coalesce(F.col(has) == F.col(asked), F.lit(False))
    return members.withColumn(tier, 2 * F.col(tier) + F.when(wanted, 0).otherwise(1))


def rank_ensemble(scored: DataFrame, query: str, item: str, columns: list[str], k: int) -> DataFrame:
    """``query, item, score, rank`` by the mean of an item's relative ranks, 1 for the best, over several scores."""
    w = lambda c: Window.partitionBy(query).orderBy(F.asc(c), F.desc(item))
    n = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(query)) - 1, F.lit(1))
    mean = reduce(Column.__add__, [(F.row_number().over(w(c)) - 1) / n for c in columns]) / len(columns)
    return topk.top_k(scored.select(query, item, F.round(mean, 9).alias("score")), query, "score", item, k)


def resorted(ranked: DataFrame, scores: DataFrame, query: str, item: str, keep: int = 30, last: int = 100, k: int = 50, weight: float = 0.5, score: str = "score") -> DataFrame:
    """``query, item, rank``: the first ``keep`` as they are, then those up to ``last`` by a blend of their rank with that
    by another score, up to k."""
    head = ranked.where(F.col("rank") <= keep).select(query, item, F.lit(0).alias("__part"), F.col("rank").cast("double").alias("__at"))
    rest = ranked.where((F.col("rank") > keep) & (F.col("rank") <= last)).join(scores.select(query, item, score), [query, item], "left")
    other = F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last(score), "rank"))
    rest = rest.select(query, item, F.lit(1).alias("__part"), ((1 - weight) * (F.col("rank") - keep) + weight * other).alias("__at"))
    w = Window.partitionBy(query).orderBy("__part", "__at", item)
    return head.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, item, "rank")


def rank_blend(first: DataFrame, second: DataFrame, query: str, item: str, k: int, weight: float = 0.5, absent: int = 1000) -> DataFrame:
    """``query, item, score, rank`` of two versions' lists by the weighted mean of their ranks."""
    a, b = (x.select(query, item, F.col("rank").alias(f"__{i}")) for i, x in enumerate((first, second)))
    mean = (1 - weight) * F.coalesce("__0", F.lit(absent)) + weight * F.coalesce("__1", F.lit(absent))
    return topk.top_k(a.join(b, [query, item], "full").select(query, item, F.round(-mean, 9).alias("score")), query, "score", item, k)


def importance(rows: DataFrame, groups: dict[str, list[str]], score: Callable[[DataFrame], Column], query: str, item: str, label: str, k: int, seed: int = 13) -> DataFrame:
    """``group, recall, drop``: recall at k of the true rows as they are (group ALL), and when a group's features are those
    of another candidate of the query: each takes the next one's, in an order by hash.

    ``score`` makes a column of the rows' features.
    """
    def recall(df: DataFrame, name: str) -> DataFrame:
        top = df.withColumn("__s", F.round(score(df), 9)).withColumn("__r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("__s"), item)))
        per = top.groupBy(query).agg((F.sum(F.when(F.col("__r") <= k, F.col(label)).otherwise(0)) / F.nullif(F.sum(label), F.lit(0))).alias("r"))
        return per.agg(F.lit(name).alias("group"), F.avg("r").alias("recall"))

    order = Window.partitionBy(query).orderBy(topk.hash_order(seed, query, item), item)
    moved = {}
    for c in sorted({c for g in groups.values() for c in g}):
        following = F.lead(c).over(order)
        moved[f"__{c}"] = F.when(F.lead(F.lit(1)).over(order).isNotNull(), following).otherwise(F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    both = rows.withColumns(moved)
    parts = [recall(rows, "ALL")]
    parts += [recall(both.withColumns({c: F.col(f"__{c}") for c in columns}), name) for name, columns in groups.items()]
    out = reduce(DataFrame.unionByName, parts)
    base = parts[0].select(F.col("recall").alias("__base"))
    return out.crossJoin(F.broadcast(base)).withColumn("drop", F.col("__base") - F.col("recall")).drop("__base")  # base is one row


def misses_by(causes: DataFrame, segments: DataFrame, query: str, segment: str) -> DataFrame:
    """``segment, cause, n, share`` of ``causes (query, cause)``, a row a true pair, by the queries' segment."""
    rows = causes.join(segments.select(query, segment), query).groupBy(segment, "cause").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(segment)))
