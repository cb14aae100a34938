"""The answer table: a row for each query with its items, its writer and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST = 50
QUERY_FORMAT, ITEM_FORMAT = "^[0-9A-Za-z]{16}$", "^[0-9a-f]{16}$"


def rows(predictions: DataFrame, query: str, item: str, rank: str = "rank", k: int = MOST) -> DataFrame:
    """``query_id, answer``: the first k distinct items in order, blank-separated."""
    firsts = predictions.groupBy(query, item).agg(F.min(rank).alias("__r"))
    w = Window.partitionBy(query).orderBy("__r", item)
    top = firsts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(item).cast("string").alias("i")))), lambda x: x["i"])
    return top.groupBy(F.col(query).cast("string").alias("query_id")).agg(F.array_join(ids, " ").alias("answer"))


def write(answers: DataFrame, path: str) -> None:
    answers.select("query_id", "answer").write.mode("overwrite").option("header", True).csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: identifiers must not turn into numbers."""
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def errors(answers: DataFrame, queries: DataFrame, corpus: DataFrame, query: str = "query_id", item: str = "item_id", query_format: str = QUERY_FORMAT, item_format: str = ITEM_FORMAT, most: int = MOST) -> DataFrame:
    """``rule, query_id``: a row for each rule that an answer breaks; none for an answer that is right.

    Rules: header, query_format, repeated_query, unknown_query, blanks, too_many, repeated_item, item_format,
    not_in_corpus, missing_query.  Answers with fewer than ``most`` items break none.
    """
    if answers.columns != ["query_id", "answer"]:
        return answers.sparkSession.createDataFrame([("header", None)], "rule string, query_id string")
    a = answers.withColumn("answer", F.coalesce("answer", F.lit("")))
    a = a.withColumn("__items", F.when(F.col("answer") == "", F.array().cast("array<string>")).otherwise(F.split("answer", " ", -1)))
    known = queries.select(F.col(query).cast("string").alias("query_id")).distinct()
    one = lambda rule, df: df.select(F.lit(rule).alias("rule"), "query_id")
    found = [
        one("query_format", a.where(~F.coalesce(F.col("query_id").rlike(query_format), F.lit(False)))),
        one("repeated_query", a.groupBy("query_id").count().where("count > 1")),
        one("unknown_query", a.join(known, "query_id", "left_anti")),
        one("blanks", a.where((F.col("answer") != F.regexp_replace("answer", r"^\s+|\s+$", "")) | F.array_contains("__items", ""))),
        one("too_many", a.where(F.size("__items") > most)),
        one("repeated_item", a.where(F.size(F.array_distinct("__items")) < F.size("__items"))),
        one("item_format", a.where(F.exists("__items", lambda i: (i != "") & ~i.rlike(item_format)))),
        one("missing_query", known.join(a, "query_id", "left_anti")),
    ]
    named = a.select("query_id", F.explode("__items").alias("__i")).where(F.col("__i").rlike(item_format))
    absent = named.join(corpus.select(F.col(item).cast("string").alias("__i")).distinct(), "__i", "left_anti").select("query_id").distinct()
    found.append(one("not_in_corpus", absent))
    return reduce(DataFrame.unionByName, found)


def short(answers: DataFrame, most: int = MOST) -> DataFrame:
    """``query_id, n`` of answers that leave places empty: a warning, not an error."""
    n = F.when(F.coalesce("answer", F.lit("")) == "", 0).otherwise(F.size(F.split("answer", " ", -1)))
    return answers.select("query_id", n.alias("n")).where(F.col("n") < most)
