"""Statistics of the choice log: sessions, pairs, counters and the category predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import session_id
from .topk import sum_before


def sessions(log: DataFrame, columns: list[str], into: str = "query_id") -> DataFrame:
    """The log with a session: rows with equal search columns are one."""
    return log.withColumn(into, session_id(*[F.col(c) for c in columns]))


def pairs(log: DataFrame, query: str, item: str) -> DataFrame:
    """``query, item, n_choices``."""
    return log.groupBy(query, item).agg(F.count("*").alias("n_choices"))


def query_stats(queries: DataFrame, pairs: DataFrame, query: str) -> DataFrame:
    """queries with the number of distinct items chosen and of choices; null where there are none."""
    stats = pairs.groupBy(query).agg(F.count("*").alias("n_relevant"), F.sum("n_choices").alias("n_choices"))
    return queries.join(stats, query, "left")


def counters(pairs: DataFrame, texts: DataFrame, query: str, item: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choices per text, per item, and per text and item.  Pass the fit part of the pairs only."""
    rows = pairs.join(texts.select(query, text), query)
    return (
        rows.groupBy(text).agg(F.sum("n_choices").alias("text_rows")),
        rows.groupBy(item).agg(F.sum("n_choices").alias("item_choices")),
        rows.groupBy(text, item).agg(F.sum("n_choices").alias("text_item_choices")),
    )


def category_fit(choices: DataFrame, words: str, category: str, n: str = "n_choices") -> DataFrame:
    """``stem, category, p, weight``: P(category | stem) by choices, and the stem's weight 1 / ln(1 + rows).

    A stem that a query repeats counts as often.
    """
    rows = choices.where(F.col(category).isNotNull()).select(F.explode(words).alias("stem"), category, n)
    by = rows.groupBy("stem", category).agg(F.sum(n).cast("double").alias("c"), F.count("*").alias("k"))
    w = Window.partitionBy("stem")
    return by.select("stem", category, (F.col("c") / F.sum("c").over(w)).alias("p"), (1.0 / F.log1p(F.sum("k").over(w).cast("double"))).alias("weight"))


def category_predict(queries: DataFrame, query: str, words: str, model: DataFrame, category: str, digits: int = 9) -> DataFrame:
    """``query, category, p, category_rank`` (from 0): the weighted mix over the query's distinct known stems."""
    terms = queries.select(query, F.explode(F.array_distinct(words)).alias("stem"))
    # the parts are added up in the order of their stems, so that the sum is the same in every run
    mix = terms.join(model, "stem").groupBy(query, category).agg(F.array_sort(F.collect_list(F.struct("stem", (F.col("weight") * F.col("p")).alias("x")))).alias("a"))
    mix = mix.withColumn("s", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["x"]), digits))
    mix = mix.withColumn("p", F.round(F.col("s") / F.sum("s").over(Window.partitionBy(query)), digits))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("s"), F.asc(category))) - 1
    return mix.select(query, category, "p", rank.alias("category_rank"))


def covering_set(predicted: DataFrame, query: str, category: str, coverage: float) -> DataFrame:
    """The least number of most probable categories that reach the coverage: those with less than it before them."""
    before = sum_before("p", query, [F.col("category_rank")])
    return predicted.withColumn("before", F.round(before, 9)).where(F.col("before") < coverage)


def leave_own_out(rows: DataFrame, text: str, query: str, n: str) -> DataFrame:
    """rows with ``others``: the choices of the same text in other sessions."""
    return rows.withColumn("others", F.sum(n).over(Window.partitionBy(text)) - F.sum(n).over(Window.partitionBy(text, query)))
