"""Queries over the test tables for the operators of the pipeline's stages: building, fields, pools, lists, vectors,
splits, analyses and sinks.  The stand-ins are those of ``catalog``; made-up parameter texts are put together from
columns, so that SQL knows what is to be found in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, params, text
from ..operators import analysis, bm25, candidates, dataset, dense, features, labels, metrics, places, rerank, sinks, split, topk
from . import catalog as C
from .catalog import query, table


def _place(spark: SparkSession, name: str) -> str:
    """A folder of one run below the one that the cluster's executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# numbers and parameter texts


@query("""
WITH p AS (SELECT *, CASE WHEN c_acctbal > 0 AND c_acctbal < 5000 THEN c_acctbal END AS price_clean FROM customer)
SELECT c_custkey, price_clean, round(ln(1 + coalesce(price_clean, 0)), 9) AS log_price, c_mktsegment = 'BUILDING' AS is_building, c_nationkey IN (1, 2, 3) AS known,
  CASE WHEN price_clean <= 300 THEN '<=300' WHEN price_clean <= 1000 THEN '301-1000' WHEN price_clean <= 3000 THEN '1001-3000' WHEN price_clean <= 10000 THEN '3001-10000' END AS pool_bucket
FROM p
""")
def clean_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("price_clean", numeric.valid_price(F.col("c_acctbal"), 5000.0))
    return rows.select(
        "c_custkey",
        "price_clean",
        F.round(F.log1p(F.coalesce("price_clean", F.lit(0.0))), 9).alias("log_price"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_building"),
        F.col("c_nationkey").isin(1, 2, 3).alias("known"),
        split.pool_bucket(F.col("price_clean")).alias("pool_bucket"),
    )


@query("""
SELECT c_custkey, c_mktsegment AS vid, c_name AS tip, 'A' || (c_custkey % 3) || ' | B' AS price_list, true AS work_at_client, c_custkey % 2 = 0 AS work_online, false AS travel_none,
  CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 7 + c_custkey % 7 + 2) / 2.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 10.0::DOUBLE END AS experience_years,
  c_custkey % 2 = 1 AS has_guarantee, true AS online_booking, CAST(2 AS BIGINT) AS price_list_size FROM customer
""")
def item_parameters(spark, sf_dir):
    k = F.col("c_custkey")
    years = F.when(k % 4 == 0, F.concat((k % 7).cast("string"), F.lit("–"), (k % 7 + 2).cast("string"), F.lit(" лет"))).when(k % 4 == 1, "Меньше года").when(k % 4 == 2, "Больше 10 лет").otherwise("есть")
    parts = [
        F.lit("вступление Вид услуги "),
        F.col("c_mktsegment"),
        F.lit(" Тип услуги "),
        F.col("c_name"),
        F.lit(" Название услуги A"),
        (k % 3).cast("string"),
        F.lit(" Услуга Своя услуга Услуга B Как вы работаете У клиента"),
        F.when(k % 2 == 0, ", Онлайн").otherwise(""),
        F.lit(" Опыт работы "),
        years,
        F.when(k % 2 == 1, " Гарантия да").otherwise(""),
        F.lit(" Онлайн-запись"),
    ]
    rows = table(spark, sf_dir, "customer").withColumns(params.item_fields(F.concat(*parts)))
    return rows.select("c_custkey", "vid", "tip", "price_list", "work_at_client", "work_online", "travel_none", "experience_years", "has_guarantee", "online_booking", "price_list_size")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN c_mktsegment ELSE '' END AS f_vid, CASE c_custkey % 3 WHEN 2 THEN c_mktsegment ELSE '' END AS f_subject, CASE c_custkey % 3 WHEN 2 THEN 'Частник' ELSE '' END AS f_who,
  c_custkey % 3 = 2 AS f_online_booking, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Вид услуги' ELSE 'Кто оказывает услуги | Онлайн-запись | Предмет или специальность' END AS f_keys FROM customer
""")
def search_parameters(spark, sf_dir):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    asked = F.when(k % 3 == 1, F.concat(F.lit("Вид услуги "), seg)).when(k % 3 == 2, F.concat(F.lit("Предмет или специальность "), seg, F.lit(" Кто оказывает услуги Частник Онлайн-запись да")))
    rows = table(spark, sf_dir, "customer").withColumns(params.search_filters(asked))
    return rows.select("c_custkey", "f_vid", "f_subject", "f_who", "f_online_booking", "f_keys")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'ECONOMY / x. ' ELSE '' END || array_to_string(list_filter([p_name, substr(p_brand || ' ' || p_type, 1, 200)], lambda x: x <> ''), '. ') AS doc FROM part
""")
def document_texts(spark, sf_dir):
    fifth = F.col("p_partkey") % 5 == 0
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type").alias("list"), F.when(fifth, "ECONOMY").alias("vid"), F.when(fifth, "x").alias("tip"))
    title = F.when(fifth, F.lit("")).otherwise(F.col("p_name"))
    price_list = F.when(fifth, F.concat_ws(". ", "p_name", "list")).otherwise(F.col("list"))
    return rows.select("p_partkey", dataset.document_text(title, F.col("vid"), F.col("tip"), F.lit(None).cast("string"), price_list, F.lit(None).cast("string")).alias("doc"))


# queries' words

STOP = ["the", "of"]
GAZ_SQL = f"""{C.D_SQL}, l AS (SELECT lang, list_distinct(w) AS w FROM d JOIN documents USING (doc_id)),
a AS (SELECT stem, count(*) AS address_df FROM (SELECT unnest(w) AS stem FROM l WHERE lang = 'fr') WHERE length(stem) >= 3 AND NOT regexp_matches(stem, '[0-9]') GROUP BY stem HAVING count(*) >= 3),
t AS (SELECT stem, count(*) AS title_df FROM (SELECT unnest(w) AS stem FROM l WHERE lang = 'en') GROUP BY stem),
gaz AS (SELECT stem, address_df, coalesce(title_df, 0) AS title_df FROM a LEFT JOIN t USING (stem) WHERE coalesce(title_df, 0) <= address_df * 0.12 AND stem NOT IN ('the', 'of'))"""
MARKS_SQL = f"""{GAZ_SQL}, b AS (SELECT item_id, {C.WORDS.format("text")} AS w FROM benchmark), marks AS (
SELECT item_id, CAST(len(w) AS BIGINT) AS q_n_words, array_to_string(list_filter([CASE WHEN list_has_any(w, ['that', 'and']) THEN 'buy' END, CASE WHEN list_contains(w, 'in') THEN 'rent' END], lambda x: x IS NOT NULL), ',') AS q_intent,
  list_has_any(w, ['to', 'le']) AS q_has_modifier, regexp_matches(array_to_string(w, ' '), '[a-z]') AS q_has_latin, regexp_matches(array_to_string(w, ' '), '[0-9]') AS q_has_digits,
  len(list_filter(w, lambda x: x IN (SELECT stem FROM gaz))) AS n_toponyms FROM b)"""


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", text.tokens(F.col("text")).alias("words"))
    return features.gazetteer(docs.where("lang = 'fr'"), docs.where("lang = 'en'"), "words", "words", STOP, least_df=3)


@query(f"WITH {GAZ_SQL} SELECT * FROM gaz")
def gazetteer(spark, sf_dir):
    return _gazetteer(spark, sf_dir)


@query(f"""
WITH {GAZ_SQL}, b AS (SELECT item_id, {C.WORDS.format("text")} AS w FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(w) AS stem FROM b) JOIN gaz USING (stem) GROUP BY item_id)
SELECT item_id, CAST(len(w) AS BIGINT) AS q_n_words, array_to_string(list_filter([CASE WHEN list_has_any(w, ['that', 'and']) THEN 'buy' END, CASE WHEN list_contains(w, 'in') THEN 'rent' END], lambda x: x IS NOT NULL), ',') AS q_intent,
  list_has_any(w, ['to', 'le']) AS q_has_modifier, regexp_matches(array_to_string(w, ' '), '[a-z]') AS q_has_latin, regexp_matches(array_to_string(w, ' '), '[0-9]') AS q_has_digits, CAST(coalesce(n, 0) AS INTEGER) AS n_toponyms
FROM b LEFT JOIN n USING (item_id)
""")
def query_markers(spark, sf_dir):
    asks = C._searches(spark, sf_dir)
    out = features.query_features(asks, "words", "words", _gazetteer(spark, sf_dir), "item_id", {"rent": ["in"], "buy": ["that", "and"]}, ["to", "le"])
    return out.select("item_id", "q_n_words", F.array_join("q_intent", ",").alias("q_intent"), "q_has_modifier", "q_has_latin", "q_has_digits", F.size("q_toponyms").alias("n_toponyms"))


@query(f"""
WITH b AS (SELECT list_has_any({C.WORDS.format("text")}, ['to', 'le']) AS q_has_modifier, regexp_matches({C.NORMAL.format("text")}, '[0-9]') AS q_has_digits FROM benchmark)
SELECT round(avg(CAST(q_has_modifier AS DOUBLE)), 9) AS q_has_modifier, round(avg(CAST(q_has_digits AS DOUBLE)), 9) AS q_has_digits FROM b
""")
def marker_shares(spark, sf_dir):
    marks = ["q_has_modifier", "q_has_digits"]
    return analysis.shares(query_markers(spark, sf_dir), marks).select(*[F.round(c, 9).alias(c) for c in marks])


# four fields


def _fields_sql(name: str, words: str) -> str:
    """Postings of one field and the searches' scores and hits by it."""
    return f"""{name}_d AS (SELECT doc_id, {words} AS w FROM d), {name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM {name}_d) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term), {name}_c AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS avgdl FROM {name}_d),
{name}_p AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) AS weight FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_d USING (doc_id) CROSS JOIN {name}_c),
{name}_s AS (SELECT item_id, doc_id, round(sum(weight), 6) AS bm25_{name}, count(*) AS hits_{name} FROM (SELECT item_id, unnest(w) AS term FROM q) JOIN {name}_p USING (term) GROUP BY ALL)"""


FIELDS = {"title": "w[1:8]", "params": "w[9:40]", "desc": "w[41:]", "all": "w"}
FIELD_COLUMNS = [f"{p}_{f}" for f in FIELDS for p in ("bm25", "hits")]
FOUR_SQL = f"""{C.D_SQL}, q AS (SELECT item_id, list_distinct({C.WORDS.format("text")}) AS w, {C.WORDS.format("text")} AS asked FROM benchmark), {", ".join(_fields_sql(f, w) for f, w in FIELDS.items())},
pairs AS (SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY bm25_all DESC, doc_id) AS r FROM all_s) WHERE r <= 20),
four AS (SELECT item_id, doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in FIELD_COLUMNS)} FROM pairs {" ".join(f"LEFT JOIN {f}_s USING (item_id, doc_id)" for f in FIELDS)})"""


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = C._searches(spark, sf_dir)
    docs = C._documents(spark, sf_dir)
    cut = {"title": F.slice("words", 1, 8), "params": F.slice("words", 9, 32), "desc": F.slice("words", F.lit(41), F.greatest(F.size("words"), F.lit(1))), "all": F.col("words")}
    fields = {f: bm25.postings(docs.withColumn("words", c), "doc_id", "words", of=bm25.terms(asks, "words")) for f, c in cut.items()}
    pairs = topk.top_k(bm25.scores(asks, "item_id", "words", fields["all"], "doc_id"), "item_id", "score", "doc_id", 20)
    return bm25.field_scores(asks, "item_id", "words", fields, "doc_id", pairs)


@query(f"WITH {FOUR_SQL} SELECT * FROM four")
def four_fields(spark, sf_dir):
    return _four(spark, sf_dir)


@query(f"""
WITH {FOUR_SQL}, f AS (
  SELECT four.*, (1.0::DOUBLE * ((item_id * 7 + doc_id * 13) % 100)) / 100 AS cos, greatest(len(q.w), 1) AS n, list_filter(asked, lambda x, i: list_position(asked, x) = i) AS o, ' ' || array_to_string(title_d.w, ' ') || ' ' AS padded
  FROM four JOIN q USING (item_id) JOIN title_d USING (doc_id)
)
SELECT item_id, doc_id, round(bm25_all / greatest(max(bm25_all) OVER w, 1e-6), 9) AS bm25_rel_max, round(cos - max(cos) OVER w, 9) AS cos_gap_max, round(hits_title / n, 9) AS cov_title, round(hits_params / n, 9) AS cov_params,
  round(hits_desc / n, 9) AS cov_desc, round(hits_all / n, 9) AS cov_all, CAST(hits_title >= n AS DOUBLE) AS all_in_title,
  CASE WHEN len(o) < 2 THEN -1.0 ELSE CAST(len(list_filter(range(1, len(o)), lambda i: contains(padded, ' ' || o[i] || ' ' || o[i + 1] || ' '))) > 0 AS DOUBLE) END AS bigram_title, count(*) OVER w AS n_cand
FROM f WINDOW w AS (PARTITION BY item_id)
""")
def text_features(spark, sf_dir):
    asks = C._searches(spark, sf_dir).select("item_id", F.col("words").alias("q_terms"), F.size(F.array_distinct("words")).alias("n_terms"))
    titles = C._documents(spark, sf_dir).select("doc_id", F.concat(F.lit(" "), F.array_join(F.slice("words", 1, 8), " "), F.lit(" ")).alias("title_padded"))
    pairs = _four(spark, sf_dir).join(asks, "item_id").join(titles, "doc_id").withColumn("cos", (F.col("item_id") * 7 + F.col("doc_id") * 13) % 100 / 100.0)
    out = features.text_block(pairs, "item_id")
    numbers = ["bm25_rel_max", "cos_gap_max", "cov_title", "cov_params", "cov_desc", "cov_all"]
    return out.select("item_id", "doc_id", *[F.round(c, 9).alias(c) for c in numbers], "all_in_title", "bigram_title", "n_cand")


@query(f"""
WITH q AS (SELECT item_id, list_distinct({C.WORDS.format("text")}) AS w FROM benchmark), {C.D_SQL},
r AS (SELECT item_id, q.w AS w, list_distinct(d.w[1:100]) AS a, list_distinct(d.w[101:]) AS b FROM q JOIN d ON d.doc_id = q.item_id WHERE len(q.w) > 0),
x AS (
  SELECT 'head' AS field, len(list_intersect(w, a)) AS h, len(w) AS n, len(list_filter(list_intersect(w, a), lambda t: NOT list_contains(b, t))) AS o FROM r
  UNION ALL SELECT 'tail', len(list_intersect(w, b)), len(w), len(list_filter(list_intersect(w, b), lambda t: NOT list_contains(a, t))) FROM r
)
SELECT field, round(avg(h / n), 9) AS found, round(avg(CAST(h = 0 AS DOUBLE)), 9) AS none, round(avg(CAST(h = n AS DOUBLE)), 9) AS "all", round(avg(o / n), 9) AS only FROM x GROUP BY field
""")
def word_coverage(spark, sf_dir):
    docs = C._documents(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.slice("words", 1, 100).alias("head"), F.slice("words", F.lit(101), F.greatest(F.size("words"), F.lit(1))).alias("tail"))
    out = analysis.word_coverage(C._searches(spark, sf_dir), "item_id", "words", docs, ["head", "tail"])
    return out.select("field", *[F.round(c, 9).alias(c) for c in ("found", "none", "all", "only")])


# lists

MEMBERS_SQL = f"""{C.P_SQL}, i AS (SELECT doc_id, source, lang AS vid, 0.001::DOUBLE * n_chars / (SELECT greatest(max(n_chars), 1) FROM documents) AS tie FROM documents),
asks AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN '' END AS f_vid FROM benchmark),
pools AS (SELECT item_id, source, CASE WHEN length(source) = 4 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS mult FROM benchmark CROSS JOIN (SELECT DISTINCT source FROM documents) WHERE item_id % 4 <> 0 AND (item_id + CAST(substr(source, 4) AS BIGINT)) % 5 = 0),
m AS (
  SELECT a.item_id, i.doc_id, s.score, i.tie, pools.mult, coalesce(a.f_vid, '') = '' OR i.vid = a.f_vid AS let_in,
    pools.mult IS NOT NULL OR a.item_id NOT IN (SELECT item_id FROM pools) AS inside
  FROM asks a CROSS JOIN i LEFT JOIN s USING (item_id, doc_id) LEFT JOIN pools ON pools.item_id = a.item_id AND pools.source = i.source
), t AS (
  SELECT item_id, doc_id, CASE WHEN score IS NOT NULL AND inside AND let_in THEN 0 WHEN score IS NOT NULL AND inside THEN 1 WHEN score IS NOT NULL THEN 2 WHEN mult IS NOT NULL AND let_in THEN 3 ELSE 4 END AS tier,
    round(CASE WHEN score IS NOT NULL THEN score * coalesce(mult, 1) + tie ELSE tie END, 9) AS key FROM m
), lex AS (SELECT item_id, doc_id, CAST(tier AS INTEGER) AS tier, key, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tier, key DESC, doc_id) AS rank FROM t WHERE doc_id % 11 <> item_id % 11) WHERE rank <= 30)"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("vid"), F.col("n_chars").cast("double").alias("n"), F.col("doc_id").alias("pos"))
    docs = bm25.popularity(docs, "n")
    k = F.col("item_id")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.when(k % 3 == 0, "en").when(k % 3 == 1, "").alias("f_vid"))
    number = F.substring("source", 4, 9).cast("long")
    sources = docs.select("source").distinct()
    # a row a source, of which there are few
    pools = bench.where(k % 4 != 0).crossJoin(F.broadcast(sources)).where((k + number) % 5 == 0).select("item_id", "source", F.when(F.length("source") == 4, 1.0).otherwise(0.6).alias("mult"))
    rows = candidates.members(C._scored(spark, sf_dir).select("item_id", "doc_id", "score"), pools, docs, bench, "item_id", "doc_id", "source", 100, lexical=True)
    chosen = bench.select("item_id").join(docs.select("doc_id"), F.col("doc_id") % 11 == k % 11)
    return candidates.ranked(rows, "item_id", "doc_id", 30, exclude=chosen)


@query(f"WITH {MEMBERS_SQL} SELECT * FROM lex")
def lexical_list(spark, sf_dir):
    return _lexical(spark, sf_dir).select("item_id", "doc_id", "tier", "key", "rank")


@query(f"WITH {C.FUSED_SQL} SELECT * FROM fused")
def base_hybrid(spark, sf_dir):
    _, a, b = C._lists(spark, sf_dir)
    return candidates.base_hybrid(a, b, "cust", "part", C.QUOTA, C.FUSED)


@query(f"""
WITH {C.LISTS_SQL}, {C.TRUTH_SQL}, j AS (SELECT a.rank AS r FROM truth LEFT JOIN a USING (cust, part))
SELECT CAST(depth AS INTEGER) AS depth, round(avg(CASE WHEN r <= depth THEN 1.0 ELSE 0.0 END), 9) AS found FROM j CROSS JOIN (VALUES (1), (5), (20)) x(depth) GROUP BY depth
""")
def depth_curve(spark, sf_dir):
    pur, a, _ = C._lists(spark, sf_dir)
    return metrics.depth_curve(a, pur.where("hit"), "cust", "part", [1, 5, 20]).withColumn("found", F.round("found", 9))


CAUSE_SQL = f"""{C.LISTS_SQL}, {C.TRUTH_SQL}, cand AS (SELECT DISTINCT cust, part FROM (SELECT cust, part FROM a UNION ALL SELECT cust, part FROM b)),
cause AS (SELECT cust, CASE WHEN a.rank <= 5 THEN 'found' WHEN cand.part IS NOT NULL THEN 'ranked_low' ELSE 'no_candidate' END AS cause FROM truth LEFT JOIN cand USING (cust, part) LEFT JOIN a USING (cust, part))"""


@query(f"WITH {CAUSE_SQL} SELECT cause, count(*) AS n FROM cause GROUP BY cause")
def misses(spark, sf_dir):
    pur, a, b = C._lists(spark, sf_dir)
    return metrics.misses(a.select("cust", "part").union(b.select("cust", "part")), a, pur.where("hit"), "cust", "part", k=5)


@query(f"""
WITH {CAUSE_SQL}, n AS (SELECT c_mktsegment, cause, count(*) AS n FROM cause JOIN customer ON c_custkey = cust GROUP BY ALL)
SELECT c_mktsegment, cause, n, round(n / sum(n) OVER (PARTITION BY c_mktsegment), 9) AS share FROM n
""")
def misses_by_segment(spark, sf_dir):
    pur, a, b = C._lists(spark, sf_dir)
    cause = metrics.causes(a.select("cust", "part").union(b.select("cust", "part")), a, pur.where("hit"), "cust", "part", k=5)
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment")
    return analysis.misses_by(cause, segments, "cust", "c_mktsegment").withColumn("share", F.round("share", 9))


@query(f"""
WITH {C.PUR_SQL}, r AS (SELECT cust, part, ((row_number() OVER (PARTITION BY cust ORDER BY qty, part DESC) - 1) / greatest(count(*) OVER (PARTITION BY cust) - 1, 1) + (row_number() OVER (PARTITION BY cust ORDER BY revenue, part DESC) - 1) / greatest(count(*) OVER (PARTITION BY cust) - 1, 1)) / 2 AS s FROM pur),
t AS (SELECT cust, part, round(s, 9) AS score FROM r)
SELECT cust, part, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, part) AS rank FROM t) WHERE rank <= 10
""")
def rank_ensemble(spark, sf_dir):
    return analysis.rank_ensemble(C._purchases(spark, sf_dir), "cust", "part", ["qty", "revenue"], 10)


@query(f"""
WITH {C.LISTS_SQL}, rest AS (SELECT a.*, row_number() OVER (PARTITION BY cust ORDER BY revenue DESC NULLS LAST, a.rank) AS other FROM a LEFT JOIN pur USING (cust, part) WHERE a.rank > 3 AND a.rank <= 15),
e AS (SELECT cust, part, 0 AS p, CAST(rank AS DOUBLE) AS spot FROM a WHERE rank <= 3 UNION ALL SELECT cust, part, 1, 0.5 * (rank - 3) + 0.5 * other FROM rest)
SELECT cust, part, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY p, spot, part) AS rank FROM e) WHERE rank <= 8
""")
def resorted_tail(spark, sf_dir):
    pur, a, _ = C._lists(spark, sf_dir)
    return analysis.resorted(a, pur, "cust", "part", keep=3, last=15, k=8, score="revenue")


@query(f"""
WITH {C.LISTS_SQL}, s AS (SELECT cust, part, round(-(0.5 * coalesce(a.rank, 1000) + 0.5 * coalesce(b.rank, 1000)), 9)::DOUBLE AS score FROM a FULL JOIN b USING (cust, part))
SELECT cust, part, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, part) AS rank FROM s) WHERE rank <= 10
""")
def version_fusion(spark, sf_dir):
    _, a, b = C._lists(spark, sf_dir)
    return analysis.rank_blend(a, b, "cust", "part", 10).withColumn("score", F.col("score").cast("double"))


@query(f"""
WITH {C.PREDICT_SQL}, b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY p_partkey ORDER BY category_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pred)
SELECT p_partkey, brand, round(p * CASE WHEN round(before, 9) < 0.5 THEN 1.0 ELSE 0.3 END, 6) AS score FROM b
""")
def category_multiplier(spark, sf_dir):
    predicted = C._predicted(spark, sf_dir)
    covering = labels.covering_set(predicted, "p_partkey", "brand", 0.5)
    out = analysis.outside_categories(predicted.select("p_partkey", "brand", F.col("p").alias("score")), covering, "p_partkey", "brand", 0.3)
    return out.select("p_partkey", "brand", F.round("score", 6).alias("score"))


@query(f"""
WITH {C.PUR_SQL}, t AS (SELECT cust, part, 2 * CASE WHEN hit THEN 0 ELSE 1 END + CASE WHEN cust % 3 = 0 OR p_brand = 'Brand#' || (cust % 5 + 1) THEN 0 ELSE 1 END AS tier, qty FROM pur JOIN part p ON p_partkey = part)
SELECT cust, part, CAST(tier AS INTEGER) AS tier, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY tier, qty DESC, part) AS rank FROM t) WHERE rank <= 10
""")
def service_tiers(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand")
    asked = F.when(F.col("cust") % 3 != 0, F.concat(F.lit("Brand#"), (F.col("cust") % 5 + 1).cast("string")))
    rows = C._purchases(spark, sf_dir).join(brands, "part").select("cust", "part", "p_brand", "qty", asked.alias("asked"), F.when(F.col("hit"), 0).otherwise(1).alias("tier"), F.col("part").alias("pos"))
    rows = analysis.service_tier(rows, "asked", "p_brand")
    return topk.tiered_top_k(rows, "cust", "part", "tier", "qty", "pos", 10).select("cust", "part", "tier", "rank")


@query(f"""
WITH {C.D_SQL}, x AS (SELECT doc_id, list_filter(w, lambda t, i: i <= 5) AS q, w[20:60] AS a FROM d)
SELECT doc_id, CASE WHEN list_has_any(q, a) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * (doc_id % 10) AS score FROM x
""")
def toponym_boost(spark, sf_dir):
    rows = C._documents(spark, sf_dir).select("doc_id", F.slice("words", 1, 5).alias("q"), F.slice("words", 20, 41).alias("a"), (F.col("doc_id") % 10).cast("double").alias("score"))
    return analysis.boosted(rows, "q", "a", 1.5).select("doc_id", "score")


# features of pairs


@query(f"""
WITH {C.PREDICT_SQL}, pairs AS (SELECT p_partkey, b.brand, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Brand#3' END AS f_vid, CASE p_partkey % 2 WHEN 0 THEN '1' ELSE '' END AS f_subject FROM part CROSS JOIN (VALUES ('Brand#1'), ('Brand#3'), ('Brand#13')) b(brand)),
n AS (SELECT p_partkey, count(*) AS n FROM pred GROUP BY p_partkey)
SELECT p_partkey, brand, CASE WHEN coalesce(f_vid, '') = '' THEN -1.0 ELSE CAST(brand = f_vid AS DOUBLE) END AS vid_match, CASE WHEN f_subject = '' THEN -1.0 ELSE CAST(contains(brand, f_subject) AS DOUBLE) END AS subject_match,
  round(coalesce(p, 0), 6) AS microcat_prob, CASE WHEN n IS NULL THEN 999.0 ELSE coalesce(CAST(category_rank AS DOUBLE), n + 1.0) END AS microcat_rank
FROM pairs LEFT JOIN pred USING (p_partkey, brand) LEFT JOIN n USING (p_partkey)
""")
def category_features(spark, sf_dir):
    k = F.col("p_partkey")
    pairs = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.explode(F.array(*map(F.lit, ("Brand#1", "Brand#3", "Brand#13")))).alias("brand"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "Brand#3").alias("f_vid"),
        F.lit(None).cast("string").alias("f_tip"),
        F.lit("").alias("f_tip_auto"),
        F.when(k % 2 == 0, "1").otherwise("").alias("f_subject"),
    )
    pairs = pairs.withColumns({"vid": F.col("brand"), "tip": F.col("brand"), "tip_auto": F.col("brand"), "subject": F.col("brand")})
    out = features.category_block(pairs, "p_partkey", "brand", C._predicted(spark, sf_dir))
    return out.select("p_partkey", "brand", "vid_match", "subject_match", F.round("microcat_prob", 6).alias("microcat_prob"), "microcat_rank")


@query(f"""
WITH q AS (SELECT item_id, {C.WORDS.format("text")} AS w FROM benchmark), p AS (SELECT item_id, q.w AS w, d.w[1:50] AS t, doc_id FROM q JOIN (SELECT doc_id, {C.WORDS.format("text")} AS w FROM documents) d ON doc_id % 97 = item_id),
i AS (SELECT *, list_filter([CASE WHEN list_contains(w, 'that') THEN 'buy' END, CASE WHEN list_contains(w, 'in') THEN 'rent' END], lambda x: x IS NOT NULL) AS intent FROM p),
h AS (SELECT *, (list_contains(intent, 'buy') AND list_has_any(t, ['of', 'the'])) OR (list_contains(intent, 'rent') AND list_has_any(t, ['to'])) AS hit FROM i)
SELECT item_id, doc_id, CASE WHEN len(intent) = 0 THEN -1.0 ELSE CAST(hit AS DOUBLE) END AS intent_match, CASE WHEN len(intent) = 0 THEN -1.0 ELSE CAST(NOT hit AS DOUBLE) END AS intent_mismatch,
  CASE WHEN list_has_any(w, ['an', 'le']) THEN CAST(doc_id % 2 = 0 AS DOUBLE) ELSE -1.0 END AS mod_home_match, CASE WHEN list_has_any(w, ['was']) THEN CAST(doc_id % 3 = 0 AS DOUBLE) ELSE -1.0 END AS mod_remote_match,
  CASE WHEN len(w[1:3]) > 0 THEN CAST(list_has_any(w[1:3], t) AS DOUBLE) ELSE -1.0 END AS toponym_in_address, CASE WHEN item_id % 2 = 0 THEN CAST(doc_id % 5 AS DOUBLE) ELSE -1.0 END AS online_booking_match, CAST(item_id % 4 = 0 AS DOUBLE) AS query_cat0
FROM h
""")
def cheap_features(spark, sf_dir):
    docs = C._documents(spark, sf_dir).select("doc_id", F.slice("words", 1, 50).alias("text_stems"), (F.col("doc_id") % 97).alias("item_id"))
    pairs = C._searches(spark, sf_dir).withColumnRenamed("words", "q_terms").join(docs, "item_id")
    intent = F.filter(F.array(F.when(F.array_contains("q_terms", "that"), "buy"), F.when(F.array_contains("q_terms", "in"), "rent")), lambda x: x.isNotNull())
    d, i = F.col("doc_id"), F.col("item_id")
    pairs = pairs.withColumns(
        {
            "q_intent": intent,
            "q_toponyms": F.slice("q_terms", 1, 3),
            "address_stems": F.col("text_stems"),
            "f_online_booking": i % 2 == 0,
            "online_booking": (d % 5).cast("double"),
            "search_category": i % 4,
            "work_at_client": (d % 2 == 0).cast("double"),
            "travel_city": F.lit(0.0),
            "work_remote": (d % 3 == 0).cast("double"),
            "work_online": F.lit(0.0),
        }
    )
    out = features.extra_block(pairs, {"buy": ["of", "the"], "rent": ["to"]}, ["an", "le"], ["was"])
    return out.select("item_id", "doc_id", *[F.col(c).cast("double").alias(c) for c in ("intent_match", "intent_mismatch", "mod_home_match", "mod_remote_match", "toponym_in_address", "online_booking_match", "query_cat0")])


@query("""
SELECT p_partkey, CAST(len(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '')) AS DOUBLE) AS title_words, CAST(length(p_type || p_name) AS DOUBLE) AS desc_chars, round(ln(1 + p_size), 9) AS log_reviews,
  CAST(p_size % 2 = 0 AS DOUBLE) AS phone_hidden, CAST(p_size % 3 = 0 AS DOUBLE) AS work_online, round(ln(1 + p_partkey % 7), 9) AS log_desc_dup, CAST(p_brand = 'Brand#1' AS DOUBLE) AS is_services FROM part
""")
def item_features(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("description", F.concat("p_type", "p_name"))
    flags = {c: F.col("p_size") % 3 == 0 for c in [*features.GROUPS["flags"], "work_remote", "travel_city", "online_booking"]}
    rows = rows.withColumns(flags | {"reviews": F.col("p_size"), "phone_hidden": F.col("p_size") % 2 == 0, "msg_forbidden": F.lit(None).cast("boolean"), "desc_dup_count": F.col("p_partkey") % 7, "is_services_category": F.col("p_brand") == "Brand#1"})
    out = features.text_lengths(features.item_block(rows), "p_name", "description")
    return out.select("p_partkey", "title_words", "desc_chars", F.round("log_reviews", 9).alias("log_reviews"), "phone_hidden", "work_online", F.round("log_desc_dup", 9).alias("log_desc_dup"), "is_services")


@query("""
WITH p AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS region, CASE WHEN c_custkey % 3 = 0 THEN 'x' END AS f, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS n FROM customer)
SELECT c_custkey, CAST(region AS DOUBLE) AS is_region, CAST(f IS NOT NULL AS DOUBLE) AS has_vid, 0.0::DOUBLE AS has_tip, round(ln(1 + coalesce(n, 0)), 6) AS log_pool, CAST(coalesce(n, 0) AS DOUBLE) AS same_text_choices,
  CAST(coalesce(n, -999) AS DOUBLE) AS n, CAST(n IS NULL AS DOUBLE) AS n_missing FROM p
""")
def query_features(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.when(k % 5 != 0, F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "region").otherwise("city").alias("loc_level"), F.when(k % 3 == 0, "x").alias("f_vid"), F.lit("").alias("f_tip"), n.alias("n"))
    rows = features.query_block(rows.withColumns({c: F.col("n") for c in ("pool_size", "text_rows", "item_choices", "text_item_choices")}))
    out = features.sentinels(rows, ["n"])
    return out.select("c_custkey", "is_region", "has_vid", "has_tip", F.round("log_pool", 6).alias("log_pool"), "same_text_choices", F.col("n").cast("double").alias("n"), F.col("n_missing").cast("double").alias("n_missing"))


# places


@query(f"""
WITH {C.SPOTS_SQL}, q AS (SELECT n_nationkey AS place FROM nation UNION ALL SELECT 100 + r_regionkey FROM region)
SELECT place, CASE WHEN place IN (SELECT place FROM spots) THEN 'city' ELSE 'region' END AS loc_level FROM q
""")
def location_level(spark, sf_dir):
    asks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place")).union(table(spark, sf_dir, "region").select(F.col("r_regionkey") + 100))
    return places.level(asks, "place", C._spots(spark, sf_dir).withColumnRenamed("place", "at"), "at").select("place", "loc_level")


@query(f"""
WITH {C.SPOTS_SQL}, seen AS (SELECT DISTINCT region, place FROM orders JOIN spots ON c_custkey = o_custkey)
SELECT c_custkey, place FROM spots WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, seen.place FROM spots JOIN seen USING (region) WHERE c_custkey % 2 = 1
""")
def flat_pools(spark, sf_dir):
    return _flat(spark, sf_dir)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = C._spots(spark, sf_dir)
    level = F.when(F.col("c_custkey") % 2 == 0, "city").otherwise("region")
    asks = spots.select("c_custkey", level.alias("loc_level"), F.when(level == "city", F.col("place")).otherwise(F.col("region")).alias("search_place"))
    chosen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).join(spots, "c_custkey").select("region", "place")
    return places.flat_pool(asks, "c_custkey", "search_place", chosen, "region", "place")


POOL_SQL = f"""{C.SPOTS_SQL}, seen AS (SELECT DISTINCT region, place FROM orders JOIN spots ON c_custkey = o_custkey),
pool AS (SELECT c_custkey, place FROM spots WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, seen.place FROM spots JOIN seen USING (region) WHERE c_custkey % 2 = 1),
sized AS (SELECT c_custkey, count(*) AS n, count(*) FILTER (WHERE c_custkey % 4 = 0 OR p.s_suppkey % 3 = c_custkey % 3) AS n_in FROM pool JOIN supplier p ON s_nationkey = place GROUP BY c_custkey)"""


def _pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("place"), (F.col("s_suppkey") % 3).cast("string").alias("vid"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise((F.col("c_custkey") % 3).cast("string")).alias("f_vid"))
    rows = places.pool_items(_flat(spark, sf_dir), shops, "place", wanted, "c_custkey")
    return rows.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum(F.col("in_vid").cast("long")).alias("n_in"))


@query(f"WITH {POOL_SQL} SELECT * FROM sized")
def filter_pools(spark, sf_dir):
    return _pool_sizes(spark, sf_dir)


@query(f"""
WITH {POOL_SQL}, l AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'city' ELSE 'region' END AS loc_level, c_custkey % 4 <> 0 AS has_vid, n_in FROM sized)
SELECT loc_level, has_vid, round(quantile_cont(n_in, 0.1), 9) AS p10, round(quantile_cont(n_in, 0.5), 9) AS p50, round(quantile_cont(n_in, 0.9), 9) AS p90, round(avg(CAST(n_in <= 5 AS DOUBLE)), 9) AS share_small FROM l GROUP BY ALL
""")
def pool_quantiles(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _pool_sizes(spark, sf_dir).select(F.when(k % 2 == 0, "city").otherwise("region").alias("loc_level"), (k % 4 != 0).alias("has_vid"), "n_in")
    out = analysis.quantiles(rows, ["loc_level", "has_vid"], "n_in", small=5)
    return out.select("loc_level", "has_vid", *[F.round(c, 9).alias(c) for c in ("p10", "p50", "p90", "share_small")])


@query(f"""
WITH {C.SHARES_SQL}, {C.CENTRES_SQL.removeprefix(C.SPOTS_SQL + ", ")}, core AS (SELECT region, loc_lat, loc_lon FROM shares JOIN centres USING (place) WHERE before < 0.9),
km AS (SELECT c_custkey, {C.KM_SQL.replace("b.loc_lat", "core.loc_lat").replace("b.loc_lon", "core.loc_lon").replace("a.loc_lat", "spots.lat").replace("a.loc_lon", "spots.lon")} AS km FROM spots JOIN core USING (region))
SELECT c_custkey, round(min(km), 3) AS km FROM spots LEFT JOIN km USING (c_custkey) GROUP BY c_custkey
""")
def nearest_core(spark, sf_dir):
    spots = C._spots(spark, sf_dir)
    out = places.nearest_core(spots, "region", "lat", "lon", C._shares(spark, sf_dir), "place", places.centroids(spots, "place", "lat", "lon"), "km")
    return out.select("c_custkey", F.round("km", 3).alias("km"))


# building and splits


@query("""
WITH corpus AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0), log AS (SELECT p_partkey, p_name || ' v' || v AS p_name, p_size, 10 * p_partkey + v AS pos FROM part CROSS JOIN (VALUES (1), (2)) x(v))
SELECT p_partkey, p_name, p_size, true AS in_corpus FROM corpus
UNION ALL SELECT p_partkey, p_name, p_size, false FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS i FROM log ANTI JOIN corpus USING (p_partkey)) WHERE i = 1
""")
def item_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.col("p_partkey").alias("pos"))
    log = parts.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).select("p_partkey", F.concat("p_name", F.lit(" v"), F.col("v").cast("string")).alias("p_name"), "p_size", (10 * F.col("pos") + F.col("v")).alias("pos"))
    return dataset.merge_items(parts.where("p_partkey % 3 <> 0"), log, "p_partkey", "pos").drop("pos")


@query("SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def conflicting_versions(spark, sf_dir):
    return dataset.conflicting_versions(table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus"), "l_partkey", ["l_returnflag", "l_linestatus"])


NATIVE_SQL = f"{C.PUR_SQL}, native AS (SELECT cust FROM pur LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 2) ON p_partkey = part GROUP BY cust HAVING bool_and(p_partkey IS NOT NULL))"


@query(f"WITH {NATIVE_SQL} SELECT cust FROM native")
def native_only(spark, sf_dir):
    corpus = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("part"))
    return split.native_only(C._purchases(spark, sf_dir), corpus, "cust", "part")


@query(f"""
WITH {C.PICK_SQL}, e AS (SELECT c_custkey, c_mktsegment FROM picked WHERE c_custkey % 7 = 0)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM e) AND c_name NOT IN (SELECT c_name FROM customer JOIN e USING (c_custkey))
""")
def earlier_splits_excluded(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    earlier = C.stratified_pick(spark, sf_dir).where("c_custkey % 7 = 0").join(customers.select("c_custkey", "c_name"), "c_custkey")
    return split.exclude(customers.select("c_custkey", "c_name"), [earlier], "c_custkey", "c_name").select("c_custkey")


@query(f"""
WITH {C.PUR_SQL}, {C.PICK_SQL}, v AS (SELECT DISTINCT cust, part FROM pur WHERE cust IN (SELECT c_custkey FROM picked))
SELECT 'val_queries' AS part_of, count(*) AS n FROM picked
UNION ALL SELECT 'val_pairs', count(*) FROM v UNION ALL SELECT 'fit_queries', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM picked)
UNION ALL SELECT 'fit_pairs', count(*) FROM pur WHERE cust NOT IN (SELECT c_custkey FROM picked)
UNION ALL SELECT 'corpus', count(*) FROM (SELECT p_partkey FROM part WHERE p_size > 10 UNION SELECT part FROM v)
""")
def split_parts(spark, sf_dir):
    held = C.stratified_pick(spark, sf_dir).select(F.col("c_custkey").alias("cust"))
    corpus = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("part"))
    parts = split.load(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust")), C._purchases(spark, sf_dir).select("cust", "part"), held, corpus, "cust", "part")
    out = None
    for name in ("val_queries", "val_pairs", "fit_queries", "fit_pairs", "corpus"):
        one = getattr(parts, name).agg(F.lit(name).alias("part_of"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH {C.PICK_SQL}, n AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM picked WHERE c_custkey % 2 = 0 GROUP BY ALL)
SELECT c_mktsegment, c_nationkey, target, coalesce(n, 0) AS n, greatest(target - coalesce(n, 0), 0) AS shortfall FROM t LEFT JOIN n USING (c_mktsegment, c_nationkey)
""")
def split_diagnostics(spark, sf_dir):
    strata = ["c_mktsegment", "c_nationkey"]
    return split.diagnostics(C.stratified_pick(spark, sf_dir).where("c_custkey % 2 = 0"), split.targets(table(spark, sf_dir, "customer"), strata, 500), strata)


@query(f"""
WITH {C.PUR_SQL}, r AS (
  SELECT cust, part, p_brand, md5('13|' || cust || '|' || part) AS h FROM pur JOIN part ON p_partkey = part
), o AS (SELECT *, CASE WHEN substr(h, 32, 1) < '8' THEN 0 ELSE 1 END AS half FROM r),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY half ORDER BY CASE WHEN half = 0 THEN p_brand ELSE '' END, substr(h, 1, 2), h, cust, part) - 1) / 32) AS BIGINT) AS batch FROM o),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY half, batch, cust ORDER BY h, cust, part) AS i FROM b) WHERE i = 1),
d AS (SELECT * FROM (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY half, batch, part ORDER BY h, cust, part) AS i FROM c) WHERE i = 1)
SELECT cust, part, CAST(half AS INTEGER) AS half, batch FROM (SELECT *, count(*) OVER (PARTITION BY half, batch) AS n FROM d) WHERE n >= 8
""")
def contrastive_batches(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand")
    pairs = C._purchases(spark, sf_dir).select("cust", "part").join(brands, "part")
    return split.batches(pairs, "cust", "part", "p_brand", 32, 13).select("cust", "part", "half", "batch")


# vectors

VEC_SQL = f"{C.V_SQL}, u AS (SELECT vec_id, label, unnest(range(len(v))) AS i, unnest(v) AS x FROM v)"
CENTROID_SQL = f"""{VEC_SQL}, cs AS (SELECT label, i, sum(x * (1 + vec_id % 3)) AS s FROM u GROUP BY ALL),
cen AS (SELECT label, i, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY label)), 1e-6) AS x FROM cs)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("embedding is not null")


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense.choice_centroids(v.select("vec_id", "label", (1 + F.col("vec_id") % 3).alias("n_choices")), v, "label", "vec_id", "embedding")


def _long(df: DataFrame, by: str, vector: str) -> DataFrame:
    return df.select(by, F.posexplode(vector).alias("i", "x")).select(by, F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {CENTROID_SQL} SELECT label, i, round(x, 6) AS x FROM cen")
def choice_centroids(spark, sf_dir):
    return _long(_centroids(spark, sf_dir), "label", "centroid")


@query(f"""
WITH {CENTROID_SQL}, {C.KNN_SQL.removeprefix(C.V_SQL + ", ")}, mix AS (SELECT query_id, i, sum(x * greatest(score, 0)) AS s FROM knn JOIN cen USING (label) GROUP BY ALL)
SELECT query_id, i, round(s / greatest(sqrt(sum(s * s) OVER (PARTITION BY query_id)), 1e-6), 6) AS x FROM mix
""")
def neighbour_centroids(spark, sf_dir):
    vectors, near = C._knn(spark, sf_dir)
    near = near.join(vectors.select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")
    return _long(dense.neighbour_centroid(near, _centroids(spark, sf_dir), "query_id", "label"), "query_id", "centroid")


@query(f"""
WITH {C.KNN_SQL}, p AS (SELECT query_id, label FROM (SELECT DISTINCT query_id FROM knn) CROSS JOIN (SELECT DISTINCT label FROM v))
SELECT p.query_id, p.label, round(max(score), 6) AS hist_text_max_sim, round(avg(score), 6) AS hist_text_mean_sim, count(score) AS hist_n_texts FROM p LEFT JOIN knn ON knn.query_id = p.query_id AND knn.label = p.label GROUP BY ALL
""")
def history_similarity(spark, sf_dir):
    vectors, near = C._knn(spark, sf_dir)
    chosen = vectors.select(F.col("label").cast("long").alias("label"), "vec_id")
    # a row a label, of which there are few
    pairs = near.select("query_id").distinct().crossJoin(F.broadcast(chosen.select("label").distinct()))
    out = dense.history(pairs, chosen, near.withColumnRenamed("score", "sim"), "query_id", "label", "vec_id")
    return out.select("query_id", "label", F.round("hist_text_max_sim", 6).alias("hist_text_max_sim"), F.round("hist_text_mean_sim", 6).alias("hist_text_mean_sim"), "hist_n_texts")


@query(f"""
WITH {C.V_SQL} SELECT a.vec_id AS query_id, b.vec_id, round(list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]), lambda x, y: x + y), 6) AS score FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 50 = 0
""")
def pool_scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asks = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    pairs = asks.select("query_id", "label").join(v.select("vec_id", "label"), "label").select("query_id", "vec_id")
    return dense.pool_scores(pairs, v, asks.select("query_id", "embedding"), "vec_id", "query_id", "embedding")


@query(f"""
WITH {VEC_SQL}, h AS (SELECT vec_id, i, x, pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) AS m FROM u)
SELECT vec_id, i, CASE WHEN x = 0 THEN x ELSE round_even(x / m, 0) * m END AS x FROM h
""")
def half_precision(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("long").alias("i"), numeric.half(F.col("x")).alias("x"))


@query(f"""
WITH {C.V_SQL}, w AS (SELECT *, label % 3 AS place FROM v), near AS (
  SELECT a.vec_id, a.label, b.vec_id AS negative, round(list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]), lambda x, y: x + y), 6) AS score FROM w a JOIN w b ON a.place = b.place AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 10 = 0 AND a.place IN (SELECT place FROM w GROUP BY place HAVING count(*) > 10)
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, negative) AS r FROM near) WHERE r <= 20),
free AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY top.label, top.vec_id ORDER BY score DESC, negative) AS r FROM top WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.label = top.label AND v.vec_id = top.negative)),
one AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY md5('13|' || label || '|' || vec_id || '|' || negative), negative) AS i FROM free WHERE r > 1 AND r <= 8)
SELECT w.label, w.vec_id, negative FROM w LEFT JOIN (SELECT * FROM one WHERE i = 1) o ON o.vec_id = w.vec_id WHERE w.vec_id % 10 = 0
""")
def hard_negatives(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("place", F.col("label") % 3)
    pairs = v.where("vec_id % 10 = 0").select("label", "vec_id")
    return dense.hard_negatives(pairs, v, "vec_id", "place", "label", "embedding", v.select("label", "vec_id"), least=10, top=20, first=1, last=8)


# analyses


@query(f"""
WITH {C.PUR_SQL}, c AS (SELECT cust, p_brand, sum(n_choices) AS c FROM pur JOIN part ON p_partkey = part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY c DESC, p_brand) AS r FROM c),
s AS (SELECT cust, sum(c) FILTER (WHERE r <= 1) / sum(c) AS top_1, sum(c) FILTER (WHERE r <= 3) / sum(c) AS top_3 FROM r GROUP BY cust)
SELECT round(avg(top_1), 9) AS top_1, round(avg(top_3), 9) AS top_3 FROM s
""")
def category_concentration(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand")
    return analysis.concentration(C._purchases(spark, sf_dir).join(brands, "part"), "cust", "p_brand", "n_choices").select(F.round("top_1", 9).alias("top_1"), F.round("top_3", 9).alias("top_3"))


@query(f"WITH {C.PUR_SQL}, n AS (SELECT cust, count(*) AS n_relevant FROM pur GROUP BY cust) SELECT n_relevant, count(*) AS sessions FROM n GROUP BY n_relevant")
def items_per_session(spark, sf_dir):
    return analysis.items_per_session(C._purchases(spark, sf_dir), "cust")


@query(f"WITH {C.PUR_SQL}, n AS (SELECT cust, count(*) AS n FROM pur GROUP BY cust) SELECT round(avg(n), 9) AS mean, round(avg(1 / n), 9) AS mean_inverse FROM n")
def session_means(spark, sf_dir):
    return analysis.session_means(C._purchases(spark, sf_dir), "cust").select(F.round("mean", 9).alias("mean"), F.round("mean_inverse", 9).alias("mean_inverse"))


@query("""
WITH r AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS f_segment, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'f_segment' AS filter, count(*) AS asked, round(avg(CAST(f_segment = c_mktsegment AS DOUBLE)), 9) AS agreed FROM r WHERE f_segment <> ''
UNION ALL SELECT 'o_orderstatus', count(*), round(avg(CAST(o_orderstatus = substr(o_orderpriority, 3, 1) AS DOUBLE)), 9) FROM r WHERE o_orderstatus <> ''
""")
def filter_agreement(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("f_segment"))
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey").withColumn("third", F.substring("o_orderpriority", 3, 1))
    return analysis.agreement(rows, {"f_segment": "c_mktsegment", "o_orderstatus": "third"}).withColumn("agreed", F.round("agreed", 9))


@query("""
WITH a AS (SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS n FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS n FROM customer WHERE c_custkey % 4 = 0),
x AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) / (SELECT count(*) FROM a) AS s FROM a GROUP BY ALL UNION ALL SELECT 'c_nationkey', n, count(*) / (SELECT count(*) FROM a) FROM a GROUP BY ALL),
y AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) / (SELECT count(*) FROM b) AS s FROM b GROUP BY ALL UNION ALL SELECT 'c_nationkey', n, count(*) / (SELECT count(*) FROM b) FROM b GROUP BY ALL)
SELECT "column", value, round(coalesce(x.s, 0), 9) AS first, round(coalesce(y.s, 0), 9) AS second, round(coalesce(y.s, 0) - coalesce(x.s, 0), 9) AS shift FROM x FULL JOIN y USING ("column", value)
""")
def split_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    out = analysis.drift(rows.where("c_custkey % 4 <> 0"), rows.where("c_custkey % 4 = 0"), ["c_mktsegment", "c_nationkey"])
    return out.select("column", "value", *[F.round(c, 9).alias(c) for c in ("first", "second", "shift")])


@query("SELECT round(regr_slope(o_totalprice, o_orderkey), 9) AS slope, round(regr_intercept(o_totalprice, o_orderkey), 5) AS intercept FROM orders")
def linear_calibration(spark, sf_dir):
    return analysis.calibration(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice").select(F.round("slope", 9).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(f"""
WITH {C.FUSED_SQL}, {C.TRUTH_SQL}, {C.RECALL_SQL}, m AS (SELECT c_mktsegment, avg(recall) AS m FROM recall JOIN customer ON c_custkey = cust GROUP BY c_mktsegment), s AS (SELECT c_mktsegment, count(*) AS share FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL)
SELECT round(sum(m * share) / sum(share), 9) AS recall FROM m JOIN s USING (c_mktsegment)
""")
def reweighted_recall(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    per = C.recall_per_query(spark, sf_dir).join(customers.select(F.col("c_custkey").alias("cust"), "c_mktsegment"), "cust")
    shares = customers.where("c_custkey % 2 = 0").groupBy("c_mktsegment").agg(F.count("*").alias("share"))
    return analysis.reweighted(per, shares, ["c_mktsegment"]).withColumn("recall", F.round("recall", 9))


@query(f"WITH {C.KNN_SQL} SELECT vec_id FROM v WHERE vec_id % 3 = 0 UNION SELECT vec_id FROM knn WHERE rank <= 5")
def hard_evaluation_corpus(spark, sf_dir):
    vectors, near = C._knn(spark, sf_dir)
    return analysis.hard_corpus(vectors.where("vec_id % 3 = 0"), near, "vec_id", 5)


@query(f"""
WITH {C.PUR_SQL}, f AS (SELECT cust, part, qty, revenue / 1000 AS rev, CAST(hit AS INTEGER) AS y, md5('13|' || cust || '|' || part) AS h FROM pur),
m AS (SELECT *, coalesce(lead(qty) OVER w, first_value(qty) OVER w) AS qty2, coalesce(lead(rev) OVER w, first_value(rev) OVER w) AS rev2 FROM f WINDOW w AS (PARTITION BY cust ORDER BY h, part)),
s AS (SELECT 'ALL' AS g, cust, part, y, round(qty + 0.5 * rev, 9) AS s FROM m UNION ALL SELECT 'amount', cust, part, y, round(qty2 + 0.5 * rev, 9) FROM m UNION ALL SELECT 'money', cust, part, y, round(qty + 0.5 * rev2, 9) FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY g, cust ORDER BY s DESC, part) AS r FROM s), p AS (SELECT g, cust, sum(CASE WHEN r <= 5 THEN y ELSE 0 END) / nullif(sum(y), 0) AS rec FROM r GROUP BY ALL),
a AS (SELECT g, avg(rec) AS recall FROM p GROUP BY g)
SELECT g AS "group", round(recall, 9) AS recall, round((SELECT recall FROM a WHERE g = 'ALL') - recall, 9) AS "drop" FROM a
""")
def group_importance(spark, sf_dir):
    rows = C._purchases(spark, sf_dir).select("cust", "part", "qty", (F.col("revenue") / 1000).alias("rev"), F.col("hit").cast("int").alias("y"))
    out = analysis.importance(rows, {"amount": ["qty"], "money": ["rev"]}, lambda df: F.col("qty") + 0.5 * F.col("rev"), "cust", "part", "y", 5)
    return out.select("group", F.round("recall", 9).alias("recall"), F.round("drop", 9).alias("drop"))


# sinks and caches; what is read again is what was written


@query(f"WITH {C.D_SQL} SELECT DISTINCT unnest(w) AS word FROM d")
def dictionary_sink(spark, sf_dir):
    path = _place(spark, "words")
    sinks.write_words(C._documents(spark, sf_dir).select(F.explode("words").alias("word")), "word", path)
    return sinks.read_words(spark, path)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def parquet_sink(spark, sf_dir):
    return sinks.write_parquet(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), _place(spark, "part"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def json_sink(spark, sf_dir):
    path = _place(spark, "json")
    df = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    sinks.write_json(df, path)
    return spark.read.schema(df.schema).json(path)


@query("""
SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR) AS O, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR) AS P FROM orders GROUP BY o_orderpriority
""")
def report_sink(spark, sf_dir):
    path = _place(spark, "report")
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    sinks.write_csv(sinks.report(counts, "o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"]).fillna(0), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT c_custkey AS query_id, 'x' || c_custkey || ' y' AS answer FROM customer WHERE c_custkey % 2 = 0".replace("c_custkey AS query_id", "CAST(c_custkey AS VARCHAR) AS query_id"))
def answer_sink(spark, sf_dir):
    from ..operators import answer

    path = _place(spark, "answer")
    k = F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(k.alias("query_id"), F.concat(F.lit("x"), k, F.lit(" y")).alias("answer"))
    answer.write(rows, path)
    return answer.read(spark, path)


@query("SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS x, CAST(p_partkey % 3 = 0 AS BIGINT) AS stored_before FROM part")
def vector_cache(spark, sf_dir):
    """A third of the vectors is there before; the others only are made."""
    cache = sinks.VectorCache(spark, _place(spark, "vectors"), "p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    made = lambda before: lambda rows: rows.select("p_partkey", F.array(F.length("p_name").cast("double"), F.lit(before)).alias("embedding"))
    cache.ensure(parts.where("p_partkey % 3 = 0"), made(1.0))
    return cache.ensure(parts, made(0.0)).select("p_partkey", F.col("embedding")[0].alias("x"), F.col("embedding")[1].cast("long").alias("stored_before"))


@query("""
WITH s AS (SELECT * FROM (VALUES ('ж'), ('x')) t(x)) SELECT count(*) AS n, 2 AS columns FROM documents
""".replace("2 AS columns", "CAST(2 AS BIGINT) AS n_columns"))
def feature_cache(spark, sf_dir):
    """A table that is made once for each version; the second time it is read."""
    path = _place(spark, "features")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.cached(spark, path, "v1", lambda: docs)
    again = sinks.cached(spark, path, "v1", lambda: docs.limit(0))
    return again.agg(F.count("*").alias("n"), F.lit(len(again.columns)).cast("long").alias("n_columns"))


@query()
def reranked(spark, sf_dir):
    """Customers' purchases reordered by boosted trees that were trained on three quarters of the customers, saved and
    loaded again.  Trees have no SQL form."""
    rows = C._purchases(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("cust")))
    rows = rows.select("cust", "part", F.col("hit").cast("int").alias("label"), "qty", "revenue", "n", topk.ratio_to_max("qty", "cust").alias("qty_rel"), topk.average_rank("revenue", "cust").alias("revenue_rank"))
    columns = ["qty", "revenue", "n", "qty_rel", "revenue_rank"]
    learned = rerank.sample(rows.where("cust % 4 <> 0"), "cust", "part", "label", n=20)
    path = _place(spark, "models")
    rerank.save(rerank.train(learned, columns, "label", seeds=(13, 1), trees=5, leaf=20), path)
    return rerank.rerank(rows.where("cust % 4 = 0"), rerank.load(spark, path, 2), columns, "cust", "part", 10)
