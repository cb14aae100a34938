"""The library's queries over the test tables, and the SQL that gives the same rows.

Stand-ins: documents and parts are the corpus, benchmark texts the searches, orders with their lineitems the log of
choices (a customer chooses parts), nations the cities and regions the regions.  Places get coordinates by fixed
arithmetic.  Sums of doubles are rounded before they are ranked or returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answer, bm25, candidates, dataset, dense, features, labels, metrics, places, split, topk

FLAGSHIP = "bm25_topk"
DEPTH, QUOTA, FUSED = 20, 8, 10
#: Kilometres within which two nations are neighbours here; the made-up coordinates are far apart.
RADIUS_KM = 1500.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# texts

NORMAL = "translate(lower(coalesce({0}, '')), 'ё' || chr(160), 'е ')"
WORDS = f"regexp_extract_all({NORMAL}, '[a-zа-я0-9]+')"
#: Tokens of documents and of benchmark texts, and the postings of the documents.
D_SQL = f"d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)"
P_SQL = f"""{D_SQL}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
corpus AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS avgdl FROM d),
post AS (
  SELECT term, doc_id, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) AS weight
  FROM tf JOIN df USING (term) JOIN d USING (doc_id) CROSS JOIN corpus
),
q AS (SELECT item_id, list_distinct({WORDS.format('text')}) AS w FROM benchmark),
s AS (
  SELECT item_id, doc_id, round(sum(weight), 6) AS score, count(*) AS hits
  FROM (SELECT item_id, unnest(w) AS term FROM q) JOIN post USING (term) GROUP BY ALL
)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("words"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = _searches(spark, sf_dir)
    index = bm25.postings(_documents(spark, sf_dir), "doc_id", "words", of=bm25.terms(asks, "words"))
    return bm25.scores(asks, "item_id", "words", index, "doc_id")


@query(f"WITH {D_SQL} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM d")
def tokenize_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


@query(f"""
WITH h AS (
  SELECT doc_id, CASE WHEN length(t) >= 50 THEN md5(t) END AS h FROM (SELECT doc_id, regexp_replace({NORMAL.format('text')}, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
), n AS (SELECT h, count(*) AS n FROM h WHERE h IS NOT NULL GROUP BY h)
SELECT doc_id, coalesce(n, 1) AS desc_dup_count FROM h LEFT JOIN n USING (h)
""")
def duplicate_descriptions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(True).alias("in_corpus"))
    return dataset.duplicate_count(docs, "doc_id", "text").select("doc_id", "desc_dup_count")


@query(f"WITH {P_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df CROSS JOIN corpus")
def idf_table(spark, sf_dir):
    return bm25.idf(_documents(spark, sf_dir), "doc_id", "words").withColumn("idf", F.round("idf", 9))


@query(f"""
WITH {P_SQL}, r AS (SELECT item_id, doc_id, score, hits, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, score, hits, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50
""")
def bm25_topk(spark, sf_dir):
    return topk.top_k(_scored(spark, sf_dir), "item_id", "score", "doc_id", 50)


@query(f"""
WITH {P_SQL}, r AS (SELECT item_id, doc_id, score, hits, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, score, hits, round(hits / greatest(len(w), 1), 9) AS cov FROM r JOIN q USING (item_id) WHERE rank <= 50
""")
def bm25_coverage(spark, sf_dir):
    """Of the candidates that a search has, not of all pairs."""
    return bm25.coverage(_searches(spark, sf_dir), "item_id", "words", bm25_topk(spark, sf_dir).drop("rank")).withColumn("cov", F.round("cov", 9))


# choices

PUR_SQL = """pur AS (
  SELECT o_custkey AS cust, l_partkey AS part, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n_choices, max(l_returnflag = 'R') AS hit
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
)"""
LISTS_SQL = f"""{PUR_SQL}, a AS (
  SELECT * FROM (SELECT cust, part, qty, row_number() OVER (PARTITION BY cust ORDER BY qty DESC, part) AS rank FROM pur) WHERE rank <= {DEPTH}
), b AS (
  SELECT * FROM (SELECT cust, part, revenue, row_number() OVER (PARTITION BY cust ORDER BY revenue DESC, part) AS rank FROM pur) WHERE rank <= {DEPTH}
)"""
FUSED_SQL = f"""{LISTS_SQL}, head AS (SELECT cust, part, 0 AS p, rank FROM a WHERE rank <= {QUOTA}),
f0 AS (SELECT * FROM head UNION ALL SELECT cust, part, 1, rank FROM b ANTI JOIN head USING (cust, part)),
fused AS (SELECT cust, part, CAST(rank AS INTEGER) AS rank FROM (SELECT cust, part, row_number() OVER (PARTITION BY cust ORDER BY p, rank, part) AS rank FROM f0) WHERE rank <= {FUSED})"""
TRUTH_SQL = "truth AS (SELECT cust, part FROM pur WHERE hit)"
RECALL_SQL = "recall AS (SELECT cust, round(count(fused.part) / count(*), 9) AS recall FROM truth LEFT JOIN fused USING (cust, part) GROUP BY cust)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"), "l_quantity", "l_extendedprice", "l_returnflag")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), "o_orderpriority").join(lines, "o_orderkey")


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("cust", "part").agg(
        F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n_choices"), F.max(F.col("l_returnflag") == "R").alias("hit")
    )


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All purchases, and each customer's first by quantity and by revenue."""
    pur = _purchases(spark, sf_dir)
    return pur, topk.top_k(pur.select("cust", "part", "qty"), "cust", "qty", "part", DEPTH), topk.top_k(pur.select("cust", "part", "revenue"), "cust", "revenue", "part", DEPTH)


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pur, a, b = _lists(spark, sf_dir)
    return topk.quota_fusion(a, b, "cust", "part", QUOTA, FUSED), pur.where("hit").select("cust", "part")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1
""")
def keep_first_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return topk.keep_first(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
WITH log AS (
  SELECT substring(md5(CAST(o_custkey AS VARCHAR) || chr(31) || o_orderpriority), 1, 16) AS query_id, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), pairs AS (SELECT query_id, part, count(*) AS n FROM log GROUP BY ALL)
SELECT query_id, count(*) AS n_relevant, CAST(sum(n) AS BIGINT) AS n_choices FROM pairs GROUP BY query_id
""")
def session_stats(spark, sf_dir):
    log = labels.sessions(_log(spark, sf_dir), ["cust", "o_orderpriority"])
    return labels.query_stats(log.select("query_id").distinct(), labels.pairs(log, "query_id", "part"), "query_id")


@query(f"""
WITH {PUR_SQL}, t AS (SELECT p_brand, part, CAST(sum(n_choices) AS BIGINT) AS n FROM pur JOIN part p ON p_partkey = pur.part GROUP BY ALL)
SELECT p_brand, part, n AS text_item_choices, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS text_rows, CAST(sum(n) OVER (PARTITION BY part) AS BIGINT) AS item_choices FROM t
""")
def choice_counters(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), "p_brand")
    rows = _purchases(spark, sf_dir).select(F.col("part").alias("query_id"), "part", "n_choices")
    by_text, by_item, by_both = labels.counters(rows, brands, "query_id", "part", "p_brand")
    return by_both.join(by_text, "p_brand").join(by_item, "part").select("p_brand", "part", "text_item_choices", "text_rows", "item_choices")


@query(f"WITH {LISTS_SQL} SELECT cust, part, qty, CAST(rank AS INTEGER) AS rank FROM a")
def topk_per_group(spark, sf_dir):
    return _lists(spark, sf_dir)[1]


@query(f"""
WITH {PUR_SQL}, m AS (SELECT cust, part, CASE WHEN hit THEN 0 WHEN qty > 30 THEN 1 ELSE 2 END AS tier, revenue AS key FROM pur),
r AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY tier, key DESC, part) AS rank FROM m)
SELECT cust, part, CAST(tier AS INTEGER) AS tier, key, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {DEPTH}
""")
def tiered_topk(spark, sf_dir):
    tier = F.when(F.col("hit"), 0).when(F.col("qty") > 30, 1).otherwise(2)
    members = _purchases(spark, sf_dir).select("cust", "part", tier.alias("tier"), F.col("revenue").alias("key"), F.col("part").alias("pos"))
    return topk.tiered_top_k(members, "cust", "part", "tier", "key", "pos", DEPTH).drop("pos")


@query(f"WITH {FUSED_SQL} SELECT * FROM fused")
def quota_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)[0]


@query(f"""
WITH {LISTS_SQL}, e AS (SELECT cust, part, 0 AS p, rank FROM a WHERE rank <= 3 UNION ALL SELECT cust, part, 1, rank FROM b),
best AS (SELECT cust, part, min(p * 1000 + rank) AS spot FROM e GROUP BY ALL)
SELECT cust, part, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY spot, part) AS rank FROM best) WHERE rank <= {FUSED}
""")
def fill_up(spark, sf_dir):
    _, a, b = _lists(spark, sf_dir)
    return topk.fill_up(a.where("rank <= 3"), b, "cust", "part", FUSED)


@query(f"""
WITH {LISTS_SQL}, s AS (SELECT cust, part, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT cust, part, rank FROM a UNION ALL SELECT cust, part, rank FROM b) GROUP BY ALL)
SELECT cust, part, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, part) AS rank FROM s) WHERE rank <= {FUSED}
""")
def reciprocal_rank_fusion(spark, sf_dir):
    _, a, b = _lists(spark, sf_dir)
    return topk.reciprocal_rank_fusion([a, b], "cust", "part", FUSED)


@query(f"""
WITH {LISTS_SQL} SELECT cust, part, CAST(coalesce(a.rank - 1, {DEPTH}) AS INTEGER) AS rank_qty, CAST(coalesce(b.rank - 1, {DEPTH}) AS INTEGER) AS rank_revenue FROM a FULL JOIN b USING (cust, part)
""")
def candidate_union(spark, sf_dir):
    _, a, b = _lists(spark, sf_dir)
    return candidates.union({"qty": a, "revenue": b}, "cust", "part", {"qty": DEPTH, "revenue": DEPTH})


@query(f"""
WITH {PUR_SQL} SELECT cust, part, round(rank() OVER w + (count(*) OVER (PARTITION BY cust, qty) - 1) / 2.0, 6)::DOUBLE AS avg_rank,
  qty - max(qty) OVER (PARTITION BY cust) AS gap, round(qty / greatest(max(qty) OVER (PARTITION BY cust), 1e-6), 9) AS ratio, round(qty / sum(qty) OVER (PARTITION BY cust), 9) AS share
FROM pur WINDOW w AS (PARTITION BY cust ORDER BY qty DESC)
""")
def group_ranks(spark, sf_dir):
    return _purchases(spark, sf_dir).select(
        "cust",
        "part",
        F.round(topk.average_rank("qty", "cust"), 6).alias("avg_rank"),
        topk.gap_to_max("qty", "cust").alias("gap"),
        F.round(topk.ratio_to_max("qty", "cust"), 9).alias("ratio"),
        F.round(topk.share("qty", "cust"), 9).alias("share"),
    )


FIT_SQL = f"""{PUR_SQL}, c AS (SELECT cust, p_name AS name, p_brand AS brand, n_choices FROM pur JOIN part p ON p_partkey = pur.part),
fit AS (SELECT stem, brand, CAST(sum(n_choices) AS DOUBLE) AS c, count(*) AS k FROM (SELECT unnest({WORDS.format('name')}) AS stem, brand, n_choices FROM c) GROUP BY ALL),
model AS (SELECT stem, brand, c / sum(c) OVER (PARTITION BY stem) AS p, 1 / ln(1 + sum(k) OVER (PARTITION BY stem)) AS weight FROM fit)"""
PREDICT_SQL = f"""{FIT_SQL}, ask AS (SELECT p_partkey, unnest(list_distinct({WORDS.format('p_name')})) AS stem FROM part),
mix AS (SELECT p_partkey, brand, round(sum(weight * p), 9) AS s FROM ask JOIN model USING (stem) GROUP BY ALL),
pred AS (SELECT p_partkey, brand, round(s / sum(s) OVER (PARTITION BY p_partkey), 9) AS p, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, brand) - 1 AS INTEGER) AS category_rank FROM mix)"""


def _category_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select("p_partkey", text.tokens(F.col("p_name")).alias("words"), F.col("p_brand").alias("brand"))
    rows = _purchases(spark, sf_dir).select(F.col("part").alias("p_partkey"), "n_choices").join(parts, "p_partkey")
    return parts, labels.category_fit(rows, "words", "brand")


@query(f"WITH {FIT_SQL} SELECT stem, brand, round(p, 9) AS p, round(weight, 9) AS weight FROM model")
def category_fit(spark, sf_dir):
    return _category_model(spark, sf_dir)[1].select("stem", "brand", F.round("p", 9).alias("p"), F.round("weight", 9).alias("weight"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, model = _category_model(spark, sf_dir)
    return labels.category_predict(parts, "p_partkey", "words", model, "brand")


@query(f"WITH {PREDICT_SQL} SELECT p_partkey, brand, round(p, 6) AS p FROM pred")
def category_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("p_partkey", "brand", F.round("p", 6).alias("p"))


@query(f"""
WITH {PREDICT_SQL}, b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY p_partkey ORDER BY category_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pred)
SELECT p_partkey, count(*) AS n FROM b WHERE round(before, 9) < 0.8 GROUP BY p_partkey
""")
def covering_set(spark, sf_dir):
    return labels.covering_set(_predicted(spark, sf_dir), "p_partkey", "brand", 0.8).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(f"""
WITH {PUR_SQL} SELECT cust, part, CAST(sum(n_choices) OVER (PARTITION BY part) - sum(n_choices) OVER (PARTITION BY part, cust) AS BIGINT) AS others FROM pur
""")
def leave_own_out(spark, sf_dir):
    return labels.leave_own_out(_purchases(spark, sf_dir).select("cust", "part", "n_choices"), "part", "cust", "n_choices").drop("n_choices")


# places

SPOTS_SQL = "spots AS (SELECT c_custkey, c_nationkey AS place, n_regionkey AS region, 10.0::DOUBLE + 7 * (c_nationkey % 9) + c_custkey % 10 / 10.0::DOUBLE AS lat, 5.0::DOUBLE * c_nationkey + c_custkey % 7 / 7.0::DOUBLE AS lon FROM customer JOIN nation ON n_nationkey = c_nationkey)"
CENTRES_SQL = f"{SPOTS_SQL}, centres AS (SELECT place, median(lat) AS loc_lat, median(lon) AS loc_lon, count(*) AS loc_n_items FROM spots GROUP BY place)"
KM_SQL = "2 * 6371 * asin(sqrt(pow(sin((radians(b.loc_lat) - radians(a.loc_lat)) / 2), 2) + cos(radians(a.loc_lat)) * cos(radians(b.loc_lat)) * pow(sin((radians(b.loc_lon) - radians(a.loc_lon)) / 2), 2)))"
NEAR_SQL = f"{CENTRES_SQL}, near AS (SELECT a.place, b.place AS near, {KM_SQL} AS km FROM centres a JOIN centres b ON a.place <> b.place WHERE {KM_SQL} <= {RADIUS_KM})"
SHARES_SQL = f"""{SPOTS_SQL}, counts AS (SELECT region, place, CAST(count(*) AS DOUBLE) AS c FROM orders JOIN spots ON c_custkey = o_custkey GROUP BY ALL),
shares AS (SELECT region, place, c / sum(c) OVER (PARTITION BY region) AS share, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER (PARTITION BY region) AS before,
  CAST(row_number() OVER w - 1 AS INTEGER) AS city_rank FROM counts WINDOW w AS (PARTITION BY region ORDER BY c DESC, place))"""


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_nationkey"), F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    lat, lon = F.lit(10.0) + 7 * (k % 9) + c % 10 / F.lit(10.0), F.lit(5.0) * k + c % 7 / F.lit(7.0)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey").select("c_custkey", k.alias("place"), "region", lat.alias("lat"), lon.alias("lon"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return places.region_share(orders.join(_spots(spark, sf_dir), "c_custkey").withColumn("n", F.lit(1)), "region", "place", "n")


@query(f"WITH {CENTRES_SQL} SELECT place, round(loc_lat, 6) AS loc_lat, round(loc_lon, 6) AS loc_lon, loc_n_items FROM centres")
def place_centres(spark, sf_dir):
    return places.centroids(_spots(spark, sf_dir), "place", "lat", "lon").select("place", F.round("loc_lat", 6).alias("loc_lat"), F.round("loc_lon", 6).alias("loc_lon"), "loc_n_items")


@query(f"WITH {NEAR_SQL} SELECT place, near, round(km, 3) AS km FROM near")
def neighbours_radius(spark, sf_dir):
    return places.neighbours(places.centroids(_spots(spark, sf_dir), "place", "lat", "lon"), "place", RADIUS_KM).withColumn("km", F.round("km", 3))


@query(f"WITH {SHARES_SQL} SELECT region, place, round(share, 9) AS share, round(before, 9) AS before, city_rank FROM shares")
def region_share(spark, sf_dir):
    return _shares(spark, sf_dir).withColumn("share", F.round("share", 9)).withColumn("before", F.round("before", 9))


@query(f"""
WITH {SHARES_SQL}, {NEAR_SQL.removeprefix(SPOTS_SQL + ", ")}, q AS (SELECT c_custkey, c_custkey % 2 = 0 AS city, place, region FROM spots)
SELECT c_custkey, place, 1.0::DOUBLE AS mult FROM q WHERE city
UNION ALL SELECT c_custkey, near, 0.6::DOUBLE FROM q JOIN near USING (place) WHERE city
UNION ALL SELECT c_custkey, shares.place, CASE WHEN before >= 0.9 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END FROM q JOIN shares USING (region) WHERE NOT city
""")
def weighted_pool(spark, sf_dir):
    spots = _spots(spark, sf_dir)
    level = F.when(F.col("c_custkey") % 2 == 0, "city").otherwise("region")
    asks = spots.select("c_custkey", level.alias("loc_level"), F.when(level == "city", F.col("place")).otherwise(F.col("region")).alias("search_place"))
    near = places.neighbours(places.centroids(spots, "place", "lat", "lon"), "place", RADIUS_KM)
    return places.pool(asks, "c_custkey", "search_place", _shares(spark, sf_dir), near, "region", "place")


@query("""
WITH m AS (SELECT c_nationkey, o_orderpriority, median(o_totalprice) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT o_orderkey, round(o_totalprice / nullif(m, 0), 6) AS price_rel_city_mc, CAST(o_totalprice IS NULL AS DOUBLE) AS price_missing
FROM orders JOIN customer ON c_custkey = o_custkey JOIN m USING (c_nationkey, o_orderpriority)
""")
def price_relative(spark, sf_dir):
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").join(nations, "o_custkey")
    out = features.price_relative(orders, "c_nationkey", "o_orderpriority", "o_totalprice")
    return out.select("o_orderkey", F.round("price_rel_city_mc", 6).alias("price_rel_city_mc"), "price_missing")


@query("""
SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, trim(lower(p_name))) AS twins_city,
  CAST(rank() OVER (PARTITION BY p_brand, trim(lower(p_name)) ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, trim(lower(p_name)), p_size) - 1) / 2.0 AS DOUBLE) AS twin_rank_reviews FROM part
""")
def twins(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    return features.twins(parts, "p_brand", "p_name", "p_size").select("p_partkey", "twins_city", "twin_rank_reviews")


# vectors

V_SQL = "v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL)"
KNN_SQL = f"""{V_SQL}, d AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b), 6) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= {DEPTH})"""


def _knn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    asks = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors, dense.dense_top_k(vectors, asks, "vec_id", "query_id", "embedding", DEPTH, exclude_self=True)


@query(f"WITH {KNN_SQL} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM knn")
def dense_topk(spark, sf_dir):
    """The nearest of all vectors for every twentieth one, the stated query set of a search."""
    return _knn(spark, sf_dir)[1]


@query(f"""
WITH {KNN_SQL}, w AS (SELECT query_id, label, sum(greatest(score, 0)) AS w FROM knn GROUP BY ALL)
SELECT query_id, label, round(w / greatest(sum(w) OVER (PARTITION BY query_id), 1e-6), 6) AS share FROM w
""")
def knn_category_share(spark, sf_dir):
    vectors, near = _knn(spark, sf_dir)
    own = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.lit(1.0).alias("share"))
    return dense.neighbour_categories(near, own, "query_id", "vec_id", "label").withColumn("share", F.round("share", 6))


# evaluation and splits


@query(f"WITH {FUSED_SQL}, {TRUTH_SQL}, {RECALL_SQL} SELECT * FROM recall")
def recall_per_query(spark, sf_dir):
    fused, truth = _fused(spark, sf_dir)
    return metrics.recall_per_query(fused, truth, "cust", "part", k=FUSED).withColumn("recall", F.round("recall", 9))


@query(f"""
WITH {FUSED_SQL}, {TRUTH_SQL}, {RECALL_SQL}, j AS (SELECT recall, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation FROM recall JOIN customer ON c_custkey = cust)
SELECT 'ALL' AS segment, '' AS value, count(*) AS n, round(avg(recall), 6) AS recall FROM j
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*), round(avg(recall), 6) FROM j GROUP BY c_mktsegment
UNION ALL SELECT 'c_nationkey', nation, count(*), round(avg(recall), 6) FROM j GROUP BY nation
""")
def recall_report(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment", "c_nationkey")
    return metrics.recall_report(recall_per_query(spark, sf_dir), segments, "cust", ["c_mktsegment", "c_nationkey"]).withColumn("recall", F.round("recall", 6))


@query(f"WITH {FUSED_SQL}, {TRUTH_SQL} SELECT count(*) AS n_true, count(fused.part) AS n_found, round(count(fused.part) / count(*), 9) AS ceiling FROM truth LEFT JOIN fused USING (cust, part)")
def candidate_ceiling(spark, sf_dir):
    fused, truth = _fused(spark, sf_dir)
    return metrics.ceiling(fused, truth, "cust", "part").withColumn("ceiling", F.round("ceiling", 9))


@query(f"""
WITH {FUSED_SQL} SELECT CAST(cust AS VARCHAR) AS query_id, string_agg(CAST(part AS VARCHAR), ' ' ORDER BY rank) AS answer FROM fused GROUP BY cust
""")
def answer_rows(spark, sf_dir):
    return answer.rows(_fused(spark, sf_dir)[0], "cust", "part")


@query("""
SELECT 'missing_query' AS rule, CAST(c_custkey AS VARCHAR) AS query_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
""")
def answer_errors(spark, sf_dir):
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    corpus = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return answer.errors(answer_rows(spark, sf_dir), asks, corpus, query_format="^[0-9]+$", item_format="^[0-9]+$")


@query("""
WITH o AS (SELECT c_custkey, c_mktsegment, c_nationkey, count(o_orderkey) AS own FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, CAST(x AS BIGINT) AS other_choices, CASE WHEN x <= 0 THEN '0' WHEN x <= 1 THEN '1' WHEN x <= 3 THEN '2-3' WHEN x <= 10 THEN '4-10' WHEN x <= 100 THEN '11-100' ELSE '>100' END AS freq_bucket
FROM (SELECT c_custkey, sum(own) OVER (PARTITION BY c_mktsegment, c_nationkey) - own AS x FROM o)
""")
def frequency_buckets(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("text"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_choices"))
    return split.other_sessions(customers, own, "c_custkey", "text").select("c_custkey", "other_choices", "freq_bucket")


@query("SELECT c_mktsegment, c_nationkey, CAST(round_even(500.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS target FROM customer GROUP BY ALL")
def strata_targets(spark, sf_dir):
    return split.targets(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 500)


PICK_SQL = """t AS (SELECT c_mktsegment, c_nationkey, count(*) AS size, CAST(round_even(500.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS target FROM customer GROUP BY ALL),
once AS (
  SELECT c_custkey, c_mktsegment, c_nationkey, target, md5('13|' || c_custkey) AS h, row_number() OVER (PARTITION BY c_name ORDER BY size, c_mktsegment, c_nationkey, md5('13|' || c_custkey), c_custkey) AS i
  FROM customer JOIN t USING (c_mktsegment, c_nationkey)
), picked AS (
  SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY h, c_custkey) AS n FROM once WHERE i = 1) WHERE n <= target
)"""


@query(f"WITH {PICK_SQL} SELECT * FROM picked")
def stratified_pick(spark, sf_dir):
    """A hold-out of customers by segment and nation."""
    customers = table(spark, sf_dir, "customer")
    strata = ["c_mktsegment", "c_nationkey"]
    return split.stratified_pick(customers, split.targets(customers, strata, 500), strata, "c_custkey", "c_name", 13).select("c_custkey", *strata)


@query(f"""
WITH {PUR_SQL}, p AS (SELECT cust, part, CAST(hit AS INTEGER) AS label, max(CAST(hit AS INTEGER)) OVER (PARTITION BY cust) AS m FROM pur),
r AS (SELECT *, row_number() OVER (PARTITION BY cust, label ORDER BY md5('13|' || cust || '|' || part), part) AS n FROM p WHERE m > 0)
SELECT cust, part, label FROM r WHERE label > 0 OR n <= 5
""")
def training_negatives(spark, sf_dir):
    """All chosen pairs that were returned and up to 5 others of each customer that has one."""
    pairs = _purchases(spark, sf_dir).select("cust", "part", F.col("hit").cast("int").alias("label"))
    return split.negatives(pairs, "cust", "part", "label", n=5, need_positive=True)


@query("""
SELECT 'filled' AS measure, 'text' AS column, round(avg(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END), 9) AS value FROM documents
UNION ALL SELECT 'filled', 'lang', round(avg(CASE WHEN coalesce(lang, '') = '' THEN 0 ELSE 1 END), 9) FROM documents
""")
def quality_report(spark, sf_dir):
    return dataset.quality_report(table(spark, sf_dir, "documents"), filled=["text", "lang"]).withColumn("value", F.round("value", 9))
