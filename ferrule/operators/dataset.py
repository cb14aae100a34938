"""Building the tables of a run: items, texts, queries and pairs, with a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params, text
from ..functions.numeric import valid_price
from . import labels, places, topk

SEARCH = ["search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"]
SERVICES = 114


def merge_items(corpus: DataFrame, train: DataFrame, item: str, pos: str) -> DataFrame:
    """The corpus' version of each item, then the first version of the items that only the log has."""
    mine = topk.keep_first(corpus, item, pos).withColumn("in_corpus", F.lit(True))
    others = topk.keep_first(train.join(corpus.select(item), item, "left_anti"), item, pos).withColumn("in_corpus", F.lit(False))
    return mine.unionByName(others)


def conflicting_versions(items: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """``item, versions`` of items that are given in more than one way."""
    return items.groupBy(item).agg(F.countDistinct(F.struct(*columns)).alias("versions")).where("versions > 1")


def duplicate_count(items: DataFrame, item: str, content: str, of: str = "in_corpus", least: int = 50) -> DataFrame:
    """items with ``desc_dup_count``: how many of the corpus share the text, 1 where it is short or alone."""
    keyed = items.withColumn("__h", text.content_hash(F.col(content), least))
    counts = keyed.where(F.col(of) & F.col("__h").isNotNull()).groupBy("__h").agg(F.count("*").alias("__n"))
    return keyed.join(counts, "__h", "left").withColumn("desc_dup_count", F.coalesce("__n", F.lit(1))).drop("__h", "__n")


def build_items(corpus: DataFrame, train: DataFrame, pos: str = "pos") -> DataFrame:
    """The items with their 21 parsed fields and cleaned numbers."""
    rows = merge_items(corpus, train, "item_id", pos)
    rows = rows.withColumns(params.item_fields(F.col("item_infm_params_text")))
    rows = duplicate_count(rows, "item_id", "item_description_raw")
    return rows.withColumns(
        {
            "lat": F.col("item_latitude").cast("double"),
            "lon": F.col("item_longitude").cast("double"),
            "price_clean": valid_price(F.col("item_price")),
            "log_reviews": F.log1p(F.coalesce(F.col("item_rating_reviews_count").cast("double"), F.lit(0.0))),
            "is_services_category": F.col("item_category_id") == SERVICES,
        }
    )


def build_texts(items: DataFrame) -> DataFrame:
    """``item_id, title_stems, params_stems, desc_stems`` as arrays of stems without stop words."""
    joined = F.concat_ws(" | ", *[F.col(c) for c in ("vid", "tip", "tip_auto", "subject", "price_list", "brands")])
    out = items.select(
        "item_id",
        text.without_stop_words(text.tokens(F.col("item_title_raw"))).alias("t"),
        text.without_stop_words(text.tokens(joined)).alias("p"),
        text.without_stop_words(text.tokens(F.col("item_description_raw"))).alias("d"),
    )
    for words, into in (("t", "title_stems"), ("p", "params_stems"), ("d", "desc_stems")):
        out = text.stems(out, "item_id", words, into)
    return out.drop("t", "p", "d")


def document_text(title, vid, tip, subject, price_list, description):
    """What an encoder is given of a listing: its parts that are not empty, cut as they are there."""
    blank = F.lit("")
    head = F.array_join(F.filter(F.array(vid, tip, subject), lambda x: F.coalesce(x, blank) != ""), " / ")
    parts = F.array(F.coalesce(title, blank), head, F.substring(F.coalesce(price_list, blank), 1, 200), F.substring(text.normalize(description), 1, 400))
    return F.array_join(F.filter(parts, lambda x: x != ""), ". ")


def build_queries(train: DataFrame, bench: DataFrame, items: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The queries of the log and of the benchmark, and the log's pairs."""
    log = labels.sessions(train, SEARCH)
    pairs = labels.pairs(log, "query_id", "item_id")
    mine = topk.keep_first(log.select("query_id", *SEARCH, pos), "query_id", pos).drop(pos).withColumn("source", F.lit("train"))
    every = mine.unionByName(bench.select("query_id", *SEARCH).withColumn("source", F.lit("bench")))
    every = labels.query_stats(every, pairs, "query_id").withColumns(params.search_filters(F.col("search_infm_params_text")))
    every = places.level(every, "search_location_id", items, "item_location_id")
    centres = places.centroids(items, "item_location_id", "lat", "lon").withColumnRenamed("item_location_id", "search_location_id")
    return every.join(centres, "search_location_id", "left"), pairs


def quality_report(df: DataFrame, filled: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """``measure, column, value``: shares of rows where a column is filled, or where a flag is set."""
    shares = [(f"filled:{c}", F.avg(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 0.0).otherwise(1.0))) for c in filled]
    shares += [(f"set:{c}", F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) for c in flags]
    one = df.agg(*[e.alias(n) for n, e in shares])
    parts = [F.struct(F.lit(n.split(":")[0]).alias("measure"), F.lit(n.split(":", 1)[1]).alias("column"), F.col(f"`{n}`").alias("value")) for n, _ in shares]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
