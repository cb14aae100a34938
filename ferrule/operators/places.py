"""Places: centres, neighbours, shares of cities in a region, and pools of listings with weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import haversine_km
from .topk import sum_before

NEIGHBOUR_KM, NEIGHBOUR_WEIGHT = 100.0, 0.6
CORE_SHARE, TAIL_WEIGHT = 0.9, 0.8


def centroids(items: DataFrame, place: str, lat: str, lon: str) -> DataFrame:
    """``place, loc_lat, loc_lon, loc_n_items``: the exact medians of a place's coordinates."""
    known = items.where(F.col(place).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return known.groupBy(place).agg(F.median(lat).alias("loc_lat"), F.median(lon).alias("loc_lon"), F.count("*").alias("loc_n_items"))


def level(queries: DataFrame, search_place: str, items: DataFrame, place: str, into: str = "loc_level") -> DataFrame:
    """queries with the level of their place: a city where items are at it, else a region."""
    known = items.select(F.col(place).alias(search_place)).distinct().withColumn("__city", F.lit(True))
    return queries.join(known, search_place, "left").withColumn(into, F.when(F.col("__city"), "city").otherwise("region")).drop("__city")


def neighbours(centres: DataFrame, place: str, radius_km: float = NEIGHBOUR_KM) -> DataFrame:
    """``place, near, km`` of all pairs of places within the radius.

    Places are binned by latitude, so that a place meets those of its own band and the next ones only.
    """
    band = radius_km / 111.0
    a = centres.select(place, "loc_lat", "loc_lon", F.explode(F.array(*[F.floor(F.col("loc_lat") / band) + i for i in (-1, 0, 1)])).alias("band"))
    b = centres.select(F.col(place).alias("near"), F.col("loc_lat").alias("lat2"), F.col("loc_lon").alias("lon2"), F.floor(F.col("loc_lat") / band).alias("band"))
    km = haversine_km(F.col("loc_lat"), F.col("loc_lon"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "band").where(F.col(place) != F.col("near")).select(place, "near", km.alias("km")).where(F.col("km") <= radius_km)


def region_share(choices: DataFrame, region: str, place: str, n: str) -> DataFrame:
    """``region, place, share, before, city_rank``: a city's share of a region's choices, and the shares before it."""
    counts = choices.groupBy(region, place).agg(F.sum(n).cast("double").alias("c"))
    shares = counts.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(region)))
    order = [F.desc("c"), F.asc(place)]
    # counts are whole numbers: their sums are exact, and so is the share before
    before = sum_before("c", region, order) / F.sum("c").over(Window.partitionBy(region))
    ranked = shares.withColumn("before", before).withColumn("city_rank", F.row_number().over(Window.partitionBy(region).orderBy(*order)) - 1)
    return ranked.select(region, place, "share", "before", "city_rank")


def pool(queries: DataFrame, query: str, search_place: str, shares: DataFrame, near: DataFrame, region: str, place: str) -> DataFrame:
    """``query, place, mult``: the places of each query's pool, with their weights.

    A city: itself at 1 and its neighbours at NEIGHBOUR_WEIGHT.  A region: the cities chosen from it, those that make up
    CORE_SHARE at 1 and the others at TAIL_WEIGHT.  A region that was never seen has no rows, and all places count.
    """
    city = queries.where("loc_level = 'city'")
    own = city.select(query, F.col(search_place).alias(place), F.lit(1.0).alias("mult"))
    around = city.join(near.withColumnRenamed(place, search_place), search_place).select(query, F.col("near").alias(place), F.lit(NEIGHBOUR_WEIGHT).alias("mult"))
    seen = queries.where("loc_level = 'region'").join(shares.withColumnRenamed(region, search_place), search_place)
    weight = F.when(F.col("before") >= CORE_SHARE, TAIL_WEIGHT).otherwise(1.0)
    return own.unionByName(around).unionByName(seen.select(query, place, weight.alias("mult")))


def flat_pool(queries: DataFrame, query: str, search_place: str, chosen: DataFrame, region: str, place: str) -> DataFrame:
    """``query, place``: a city itself, or all cities ever chosen from a region; the older form, without weights."""
    own = queries.where("loc_level = 'city'").select(query, F.col(search_place).alias(place))
    seen = queries.where("loc_level = 'region'").join(chosen.select(F.col(region).alias(search_place), place).distinct(), search_place)
    return own.unionByName(seen.select(query, place))


def pool_items(pools: DataFrame, items: DataFrame, place: str, filter_of: DataFrame | None = None, query: str = "query_id", wanted: str = "f_vid", has: str = "vid") -> DataFrame:
    """The items of each query's pool, by an equi-join on the place; ``in_vid`` says if the query's filter lets them in."""
    rows = pools.join(items, place)
    if filter_of is None:
        return rows
    rows = rows.join(filter_of.select(query, wanted), query)
    return rows.withColumn("in_vid", (F.coalesce(F.col(wanted), F.lit("")) == "") | F.coalesce(F.col(has) == F.col(wanted), F.lit(False)))


def nearest_core(points: DataFrame, region: str, lat: str, lon: str, shares: DataFrame, place: str, centres: DataFrame, into: str) -> DataFrame:
    """points with the distance to the nearest core city of their region; null where it has none."""
    core = shares.where(F.col("before") < CORE_SHARE).join(centres.select(place, "loc_lat", "loc_lon"), place).select(region, "loc_lat", "loc_lon")
    core = core.groupBy(region).agg(F.array_sort(F.collect_list(F.struct("loc_lat", "loc_lon"))).alias("__cores"))
    km = F.transform("__cores", lambda c: haversine_km(F.col(lat), F.col(lon), c["loc_lat"], c["loc_lon"]))
    return points.join(core, region, "left").withColumn(into, F.array_min(km)).drop("__cores")
