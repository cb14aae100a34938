"""From candidates to the 82 features: the blocks of ``features`` joined on the pairs that the candidate lists have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot
from . import bm25, dense, features, places, topk

QUERY, ITEM, PLACE = "query_id", "item_id", "place"


@dataclass
class Context:
    """What the features are made of; statistics are those of the fit part only.

    ``queries``: query_id, search_place, search_category, loc_level, loc_lat, loc_lon, the filters f_vid, f_tip, f_tip_auto,
    f_subject, f_online_booking, and text, q_terms, q_intent, q_toponyms, q_n_words.  ``items``: item_id, place, category, lat,
    lon, the raw fields of ``features.item_block``, vid, tip, tip_auto, subject, rating, price_list_size,
    experience_years, price, reviews, title, description and the arrays title_stems, params_stems, desc_stems,
    address_stems.  ``vectors (item_id, embedding, embedding_user)`` and ``asked`` the same of queries, ``pools (query_id,
    place, mult)``, ``shares (region, place, share, before, city_rank)``, ``centres``, ``predicted (query_id, category, p,
    category_rank)``, ``text_rows (text, text_rows)``, ``item_choices (item_id, item_choices)``, ``text_item_choices (text,
    item_id, text_item_choices)``, ``neighbours (query_id, text, score)``, ``centroids (text, centroid)``,
    ``neighbour_categories (query_id, category, share)``, and ``chosen (item_id, text)`` with ``sims (query_id, text, sim)``.
    """

    queries: DataFrame
    items: DataFrame
    vectors: DataFrame
    asked: DataFrame
    pools: DataFrame
    shares: DataFrame
    centres: DataFrame
    predicted: DataFrame
    text_rows: DataFrame
    item_choices: DataFrame
    text_item_choices: DataFrame
    neighbours: DataFrame
    centroids: DataFrame
    neighbour_categories: DataFrame
    chosen: DataFrame
    sims: DataFrame
    intents: dict[str, list[str]]
    home: list[str]
    remote: list[str]


def item_table(items: DataFrame) -> DataFrame:
    """What depends on the item alone, made once for all queries."""
    out = features.twins(features.price_relative(features.item_block(items), PLACE, "category", "price"), PLACE, "title", "reviews")
    out = features.text_lengths(out, "title", "description")
    padded = F.concat(F.lit(" "), F.array_join("title_stems", " "), F.lit(" "))
    return out.withColumns({"title_padded": padded, "text_stems": F.array_union("title_stems", "params_stems")})


def _vector_features(pairs: DataFrame, c: Context) -> DataFrame:
    """Similarities of both encoders, and to the centroids of what was chosen for the nearest texts."""
    v = c.vectors.select(ITEM, F.col("embedding").alias("__v"), F.col("embedding_user").alias("__vu"))
    q = c.asked.select(QUERY, F.col("embedding").alias("__q"), F.col("embedding_user").alias("__qu"))
    mixed = dense.neighbour_centroid(c.neighbours, c.centroids, QUERY, "text")
    # a query has a few neighbours: their centroids go along as one array
    near = c.neighbours.join(c.centroids, "text").groupBy(QUERY).agg(F.collect_list("centroid").alias("__near"))
    out = pairs.join(v, ITEM, "left").join(q, QUERY, "left").join(mixed, QUERY, "left").join(near, QUERY, "left")
    rounded = lambda a, b: F.round(dot(F.col(a), F.col(b)), 6)
    return out.withColumns(
        {
            "cos": rounded("__v", "__q"),
            "cos_user": rounded("__vu", "__qu"),
            "knn_cos_centroid": rounded("__v", "centroid"),
            "knn_cos_max": F.round(F.array_max(F.transform("__near", lambda x: dot(x, F.col("__v")))), 6),
        }
    ).drop("__v", "__vu", "__q", "__qu", "__near", "centroid")


def assemble(candidates: DataFrame, base: DataFrame, c: Context) -> DataFrame:
    """``query_id, item_id`` and the columns ``features.ALL`` as floats, null where a value does not apply.

    ``candidates (query_id, item_id, rank_bm25, rank_dense, rank_user, rank_knn)`` are the union of the lists; ``base
    (query_id, item_id, rank)`` is the first hybrid list, of which the first 50 are told.
    """
    items, pairs = item_table(c.items), candidates.select(QUERY, ITEM)
    asks = c.queries.select(QUERY, F.col("q_terms").alias("words"))
    terms = bm25.terms(asks, "words")
    texts = {"title": F.col("title_stems"), "params": F.col("params_stems"), "desc": F.col("desc_stems"), "all": F.concat("title_stems", "params_stems", "desc_stems")}
    fields = {f: bm25.postings(c.items.select(ITEM, w.alias("words")), ITEM, "words", of=terms) for f, w in texts.items()}
    scored = bm25.field_scores(asks, QUERY, "words", fields, ITEM, pairs)
    out = candidates.join(scored, [QUERY, ITEM]).join(c.queries, QUERY).join(items, ITEM)
    out = out.withColumn("n_terms", F.size(F.array_distinct("q_terms")))
    out = features.text_block(_vector_features(out, c), QUERY).withColumn("cos_user_gap_max", topk.gap_to_max("cos_user", QUERY))
    out = features.place_block(out, QUERY, PLACE, "search_place", c.pools, c.shares, c.centres, "region")
    out = features.category_block(out, QUERY, "category", c.predicted)
    size = places.pool_items(c.pools.select(QUERY, PLACE).distinct(), c.items.groupBy(PLACE).agg(F.count("*").alias("n")), PLACE).groupBy(QUERY).agg(F.sum("n").alias("pool_size"))
    out = out.join(size, QUERY, "left").join(c.text_rows, "text", "left").join(c.item_choices, ITEM, "left").join(c.text_item_choices, ["text", ITEM], "left")
    out = features.extra_block(features.query_block(out), c.intents, c.home, c.remote)
    shares = c.neighbour_categories.select(QUERY, "category", F.col("share").alias("knn_microcat_share"))
    out = out.join(shares, [QUERY, "category"], "left").fillna(0.0, ["knn_microcat_share"])
    out = dense.history(out, c.chosen, c.sims, QUERY, ITEM, "text")
    first = base.where("rank <= 50").select(QUERY, ITEM, F.lit(1.0).alias("in_base50"))
    out = out.join(first, [QUERY, ITEM], "left").fillna(0.0, ["in_base50"])
    return out.select(QUERY, ITEM, *[_float(f) for f in features.ALL])


def _float(name: str) -> Column:
    return F.col(name).cast("float").alias(name)
