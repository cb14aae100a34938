"""BM25 over an inverted index that is a table of postings with ready weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str, words: str, k1: float = K1, b: float = B, of: DataFrame | None = None) -> DataFrame:
    """``term, doc, tf, w``: a row for each term of each document, with the term's frequency and weight.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)), and the weight idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)).
    ``words`` is an array column; documents without words count in N and in the mean length.  With ``of (term)``, only
    these terms are made: the others leave before anything is shuffled.
    """
    every = docs.select(doc, F.explode(words).alias("term"))
    if of is not None:
        every = every.join(of.select("term").distinct(), "term", "left_semi")
    tf = every.groupBy("term", doc).agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = docs.select(doc, F.size(F.coalesce(words, F.array().cast("array<string>"))).alias("dl"))
    corpus = size.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(df, "term").join(size, doc).crossJoin(F.broadcast(corpus)).select("term", doc, "tf", weight.alias("w"))  # corpus is one row


def idf(docs: DataFrame, doc: str, words: str) -> DataFrame:
    """``term, df, idf`` of every term."""
    df = docs.select(doc, F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def scores(queries: DataFrame, query: str, words: str, index: DataFrame, doc: str, digits: int | None = 6) -> DataFrame:
    """``query, doc, score, hits`` of every pair that shares a term; a term counts once however often it is asked."""
    terms = queries.select(query, F.explode(F.array_distinct(words)).alias("term"))
    score = F.sum("w")
    out = terms.join(index, "term").groupBy(query, doc).agg(score.alias("score"), F.count("*").alias("hits"))
    # sums of doubles depend on their order in the last digits; rounded before they are ranked, they don't
    return out if digits is None else out.withColumn("score", F.round("score", digits))


def terms(queries: DataFrame, words: str) -> DataFrame:
    """``term``: all that is asked for."""
    return queries.select(F.explode(words).alias("term")).distinct()


def coverage(queries: DataFrame, query: str, words: str, scored: DataFrame) -> DataFrame:
    """``scored`` with ``cov``: hits as a share of the query's distinct terms, known or not."""
    n = queries.select(query, F.greatest(F.size(F.array_distinct(words)), F.lit(1)).alias("terms"))
    return scored.join(n, query).withColumn("cov", F.col("hits") / F.col("terms")).drop("terms")


def field_scores(queries: DataFrame, query: str, words: str, fields: dict[str, DataFrame], doc: str, pairs: DataFrame | None = None) -> DataFrame:
    """``query, doc`` and for each field its score and hits, 0 where it has none.

    With ``pairs (query, doc)``, only these are scored: the postings are cut to the candidates before the sum.
    """
    out = None
    for name, index in fields.items():
        if pairs is not None:
            index = index.join(pairs.select(doc).distinct(), doc, "left_semi")
        one = scores(queries, query, words, index, doc).withColumnsRenamed({"score": f"bm25_{name}", "hits": f"hits_{name}"})
        out = one if out is None else out.join(one, [query, doc], "full")
    if pairs is not None:
        out = pairs.select(query, doc).join(out, [query, doc], "left")
    return out.fillna(0.0, [c for c in out.columns if c.startswith("bm25_")]).fillna(0, [c for c in out.columns if c.startswith("hits_")])


def popularity(items: DataFrame, reviews: str, tie: str = "tie", weight: float = 1e-3) -> DataFrame:
    """items with a small share of their popularity, which parts equal scores."""
    most = items.agg(F.greatest(F.max(reviews), F.lit(1.0)).alias("__most"))
    return items.crossJoin(F.broadcast(most)).withColumn(tie, weight * F.col(reviews) / F.col("__most")).drop("__most")  # most is one row
