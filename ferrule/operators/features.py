"""The 82 features of (query, candidate) pairs, in blocks that each take the pairs and add columns.

A value that does not apply is null; where the model wants a number, ``sentinels`` puts one and a flag.  Candidates are
found before, so every block joins on the pairs that are there and scores nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import haversine_km
from ..functions.text import bigrams, has_any, key
from . import places, topk

# The features' names, by group.
GROUPS = {
    "text": "bm25_all bm25_title bm25_params bm25_desc bm25_rel_max cos cos_gap_max rank_bm25 rank_dense in_base50 cov_title cov_params cov_desc cov_all all_in_title bigram_title".split(),
    "geo": "geo_mult same_city region_city_share dist_km city_center_dist_km dist_core_km region_city_rank".split(),
    "cat": "vid_match tip_match microcat_prob microcat_rank tip_auto_match subject_match".split(),
    "item": "log_reviews rating phone_hidden msg_forbidden log_desc_dup work_remote travel_city online_booking price_list_size experience_years is_services".split(),
    "query": "q_n_words is_region has_vid has_tip log_pool log_text_rows n_cand".split(),
    "sem2": "cos_user cos_user_gap_max rank_user rank_knn knn_cos_centroid knn_cos_max knn_top_sim knn_microcat_share".split(),
    "hist": "log_item_choices same_text_choices hist_text_max_sim hist_text_mean_sim hist_n_texts".split(),
    "price": ["price_rel_city_mc", "price_missing"],
    "intent": ["intent_match", "intent_mismatch"],
    "modifier": ["mod_home_match", "mod_remote_match"],
    "toponym": ["toponym_in_address"],
    "online": ["online_booking_match"],
    "flags": "work_online work_at_client work_at_self travel_region travel_zones travel_none has_contract has_guarantee works_with_legal".split(),
    "twins": ["twins_city", "twin_rank_reviews"],
    "text_len": ["title_words", "desc_chars"],
    "cat0": ["query_cat0"],
}
ALL = [c for group in GROUPS.values() for c in group]

# Words of a query's intent, and words of a listing that bear it out.
INTENT_WORDS = {
    "buy": "скупка скупаю куплю купить выкуп выкупим приму прием сдать продать".split(),
    "rent": "аренда аренду прокат напрокат снять сдам посуточно почасово".split(),
    "learn": "обучение курсы курс урок уроки научиться репетитор подготовка".split(),
    "job": "работа вакансия требуется подработка".split(),
}
INTENT_ITEM_WORDS = {
    "buy": "скупка выкуп куплю покупка прием дорого оценка".split(),
    "rent": "аренда прокат посуточно сдаю сдается почасово".split(),
    "learn": "обучение курсы урок занятия репетитор подготовка школа".split(),
    "job": "работа вакансия требуется подработка".split(),
}
MODIFIER_WORDS = "недорого дешево дешевле бесплатно срочно круглосуточно выезд выездом дому рядом частный частник профессиональный качественно хороший лучший".split()
HOME_WORDS = "дому выезд выездом выездной приезд".split()
REMOTE_WORDS = "онлайн online дистанционно удаленно удаленный zoom скайп skype".split()
ADDRESS_WORDS = (
    "улица ул область обл район р н проспект пр кт городской округ поселок посёлок пос переулок пер шоссе село деревня д край республика респ "
    "микрорайон мкр бульвар б проезд набережная наб площадь пл территория тер садовое товарищество снт сельское поселение муниципальный квартал "
    "корпус строение стр линия тупик аллея дом город г станция метро км"
).split()


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def where_asked(asked: Column, holds: Column) -> Column:
    """-1 where nothing is asked, else 1 or 0."""
    return F.when(asked, _flag(holds)).otherwise(F.lit(-1.0))


def text_block(pairs: DataFrame, query: str) -> DataFrame:
    """Of ``bm25_* hits_* n_terms cos q_terms title_padded rank_bm25 rank_dense``: relative scores, coverages and bigrams."""
    n = F.greatest(F.col("n_terms"), F.lit(1))
    pairs_of = bigrams(F.col("q_terms"))
    found = F.exists(pairs_of, lambda b: F.col("title_padded").contains(b))
    out = pairs.withColumns({f"cov_{f}": F.col(f"hits_{f}") / n for f in ("title", "params", "desc", "all")})
    return out.withColumns(
        {
            "bm25_rel_max": topk.ratio_to_max("bm25_all", query),
            "cos_gap_max": topk.gap_to_max("cos", query),
            "all_in_title": _flag(F.col("cov_title") >= 1.0),
            "bigram_title": F.when(F.size(pairs_of) == 0, F.lit(-1.0)).otherwise(_flag(found)),
            "n_cand": F.count(F.lit(1)).over(Window.partitionBy(query)),
        }
    )


def place_block(pairs: DataFrame, query: str, place: str, search_place: str, pools: DataFrame, shares: DataFrame, centres: DataFrame, region: str) -> DataFrame:
    """Of ``loc_level loc_lat loc_lon lat lon``: weights, shares and distances."""
    mult = pools.groupBy(query, place).agg(F.max("mult").alias("geo_mult"))
    out = pairs.join(mult, [query, place], "left").withColumn("geo_mult", F.coalesce("geo_mult", F.lit(1.0)))
    own = centres.select(F.col(place), F.col("loc_lat").alias("__clat"), F.col("loc_lon").alias("__clon"))
    out = out.join(own, place, "left")
    mine = shares.select(F.col(region).alias(search_place), place, F.col("share").alias("__share"), F.col("city_rank").alias("__rank"))
    out = out.join(mine, [search_place, place], "left")
    city = (F.col("loc_level") == "city") & F.col("loc_lat").isNotNull()
    away = F.col("loc_level") == "region"
    for into, lat, lon in (("__core", "lat", "lon"), ("__ccore", "__clat", "__clon")):
        out = places.nearest_core(out, search_place, lat, lon, shares.withColumnRenamed(region, search_place), place, centres, into)
    to_centre = haversine_km(F.col("loc_lat"), F.col("loc_lon"), F.col("lat"), F.col("lon"))
    centre_to_centre = haversine_km(F.col("loc_lat"), F.col("loc_lon"), F.col("__clat"), F.col("__clon"))
    return out.withColumns(
        {
            "same_city": _flag(F.col(place) == F.col(search_place)),
            "region_city_share": F.when(away, F.coalesce("__share", F.lit(0.0))).otherwise(0.0),
            "dist_km": F.when(city, to_centre),
            "city_center_dist_km": F.when(city, centre_to_centre).when(away, F.col("__ccore")),
            "dist_core_km": F.when(city, to_centre).when(away, F.col("__core")),
            "region_city_rank": F.when(away, F.col("__rank").cast("double")),
        }
    ).drop("__clat", "__clon", "__share", "__rank", "__core", "__ccore")


def category_block(pairs: DataFrame, query: str, category: str, predicted: DataFrame) -> DataFrame:
    """Of the filters ``f_vid f_tip f_tip_auto f_subject`` and the items' fields: matches, and the category's probability."""
    n = predicted.groupBy(query).agg(F.count("*").alias("__n"))
    out = pairs.join(predicted.select(query, category, F.col("p").alias("__p"), F.col("category_rank").alias("__r")), [query, category], "left").join(n, query, "left")
    asked = {f: F.coalesce(F.col(f), F.lit("")) != "" for f in ("f_vid", "f_tip", "f_tip_auto", "f_subject")}
    return out.withColumns(
        {
            "vid_match": where_asked(asked["f_vid"], F.col("vid") == F.col("f_vid")),
            "tip_match": where_asked(asked["f_tip"], F.col("tip") == F.col("f_tip")),
            "tip_auto_match": where_asked(asked["f_tip_auto"], F.col("tip_auto").contains(F.col("f_tip_auto"))),
            "subject_match": where_asked(asked["f_subject"], F.col("subject").contains(F.col("f_subject"))),
            "microcat_prob": F.coalesce("__p", F.lit(0.0)),
            "microcat_rank": F.when(F.col("__n").isNull(), F.lit(999.0)).otherwise(F.coalesce(F.col("__r").cast("double"), F.col("__n") + 1.0)),
        }
    ).drop("__p", "__r", "__n")


def item_block(items: DataFrame) -> DataFrame:
    """Of the raw fields: the item's own numbers."""
    flags = {c: _flag(F.col(c)) for c in [*GROUPS["flags"], "work_remote", "travel_city", "online_booking"]}
    return items.withColumns(
        flags
        | {
            "log_reviews": F.log1p(F.coalesce(F.col("reviews").cast("double"), F.lit(0.0))),
            "phone_hidden": _flag(F.col("phone_hidden")),
            "msg_forbidden": _flag(F.col("msg_forbidden")),
            "log_desc_dup": F.log1p(F.col("desc_dup_count").cast("double")),
            "is_services": _flag(F.col("is_services_category")),
        }
    )


def text_lengths(items: DataFrame, title: str, description: str) -> DataFrame:
    """items with ``title_words``, the blank-separated words of the title, and ``desc_chars``."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(title), F.lit("")), r"\s+"), lambda w: w != ""))
    return items.withColumns({"title_words": words.cast("double"), "desc_chars": F.length(F.coalesce(F.col(description), F.lit(""))).cast("double")})


def price_relative(items: DataFrame, place: str, category: str, price: str) -> DataFrame:
    """items with the price as a multiple of the exact median of its place and category, and a flag for no price."""
    median = items.groupBy(place, category).agg(F.median(price).alias("__m"))
    out = items.join(median, [place, category], "left")
    return out.withColumn("price_rel_city_mc", F.col(price) / F.nullif(F.col("__m"), F.lit(0.0))).withColumn("price_missing", F.col(price).isNull().cast("double")).drop("__m")


def twins(items: DataFrame, place: str, title: str, reviews: str) -> DataFrame:
    """items with the number of equal titles in the place and the average rank by reviews among them."""
    out = items.withColumn("__key", key(F.col(title)))
    by = [place, "__key"]
    return out.withColumn("twins_city", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("twin_rank_reviews", topk.average_rank(reviews, by)).drop("__key")


def extra_block(pairs: DataFrame, intents: dict[str, list[str]], home: list[str], remote: list[str]) -> DataFrame:
    """Of ``q_intent q_terms q_toponyms f_online_booking search_category`` and the item's stems: the cheap matches.

    The word lists are given as stems.  ``q_intent`` and ``q_toponyms`` are arrays.
    """
    intent_hit = F.lit(False)
    for name, stems in intents.items():
        intent_hit = intent_hit | (F.array_contains("q_intent", name) & has_any(F.col("text_stems"), stems))
    asked = F.size("q_intent") > 0
    return pairs.withColumns(
        {
            "intent_match": where_asked(asked, intent_hit),
            "intent_mismatch": where_asked(asked, ~F.coalesce(intent_hit, F.lit(False))),
            "mod_home_match": where_asked(has_any(F.col("q_terms"), home), (F.col("work_at_client") > 0) | (F.col("travel_city") > 0)),
            "mod_remote_match": where_asked(has_any(F.col("q_terms"), remote), (F.col("work_remote") > 0) | (F.col("work_online") > 0)),
            "toponym_in_address": where_asked(F.size("q_toponyms") > 0, F.arrays_overlap("q_toponyms", "address_stems")),
            "online_booking_match": F.when(F.coalesce("f_online_booking", F.lit(False)), F.col("online_booking")).otherwise(-1.0),
            "query_cat0": _flag(F.col("search_category") == 0),
        }
    )


def query_block(pairs: DataFrame) -> DataFrame:
    """Of ``loc_level f_vid f_tip pool_size text_rows item_choices text_item_choices``: constants of the query and counters."""
    count = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return pairs.withColumns(
        {
            "is_region": _flag(F.col("loc_level") == "region"),
            "has_vid": _flag(F.coalesce("f_vid", F.lit("")) != ""),
            "has_tip": _flag(F.coalesce("f_tip", F.lit("")) != ""),
            "log_pool": F.log1p(count("pool_size")),
            "log_text_rows": F.log1p(count("text_rows")),
            "log_item_choices": F.log1p(count("item_choices")),
            "same_text_choices": count("text_item_choices"),
        }
    )


def sentinels(pairs: DataFrame, columns: list[str], value: float = -999.0) -> DataFrame:
    """Each column as a float; nulls become the value and are told in ``<column>_missing``."""
    out = {}
    for c in columns:
        out[c] = F.coalesce(F.col(c).cast("float"), F.lit(value).cast("float"))
        out[f"{c}_missing"] = F.col(c).isNull().cast("float")
    return pairs.withColumns(out)


def query_features(queries: DataFrame, words: str, stems: str, gazetteer: DataFrame, query: str, intents: dict[str, list[str]], modifiers: list[str]) -> DataFrame:
    """queries with their word count, intents, toponyms and flags; ``words`` without stop words, ``stems`` theirs."""
    text = F.array_join(words, " ")
    intent = F.filter(F.array(*[F.when(has_any(F.col(stems), s), F.lit(n)) for n, s in sorted(intents.items())]), lambda x: x.isNotNull())
    out = queries.withColumns(
        {
            "q_n_words": F.size(words).cast("long"),
            "q_intent": intent,
            "q_has_modifier": has_any(F.col(stems), modifiers),
            "q_has_latin": text.rlike("[a-z]"),
            "q_has_digits": text.rlike("[0-9]"),
        }
    )
    named = out.select(query, F.posexplode(stems).alias("__i", "stem")).join(gazetteer.select("stem"), "stem", "left_semi")
    named = named.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "stem"))), lambda x: x["stem"]).alias("q_toponyms"))
    return out.join(named, query, "left").withColumn("q_toponyms", F.coalesce("q_toponyms", F.array().cast("array<string>")))


def gazetteer(addresses: DataFrame, titles: DataFrame, address_stems: str, title_stems: str, stop: list[str], least_df: int = 20, most_title: float = 0.12) -> DataFrame:
    """``stem, address_df, title_df`` of the words of addresses that name places: frequent there, rare in titles."""
    a = addresses.select(F.explode(F.array_distinct(address_stems)).alias("stem")).where((F.length("stem") >= 3) & ~F.col("stem").rlike("[0-9]"))
    a = a.groupBy("stem").agg(F.count("*").alias("address_df")).where(F.col("address_df") >= least_df)
    t = titles.select(F.explode(F.array_distinct(title_stems)).alias("stem")).groupBy("stem").agg(F.count("*").alias("title_df"))
    out = a.join(t, "stem", "left").withColumn("title_df", F.coalesce("title_df", F.lit(0)))
    return out.where((F.col("title_df") <= F.col("address_df") * most_title) & ~F.col("stem").isin(stop))
