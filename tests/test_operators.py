import math

import pytest
from pyspark.sql import functions as F

from ferrule.functions import numeric, params, text
from ferrule.functions.stemmer import stem
from ferrule.operators import answer, bm25, labels, metrics, places, split, topk


def test_tiers_fill_in_order_and_leave_out(spark):
    rows = [(1, i, t, float(9 - i)) for i in range(10) for t in ([0, 2] if i < 3 else [2])]
    members = spark.createDataFrame(rows, "q long, i long, tier int, key double").withColumn("pos", F.col("i"))
    out = topk.tiered_top_k(members, "q", "i", "tier", "key", "pos", 5, spark.createDataFrame([(1, 1), (1, 2)], "q long, i long"))
    assert [r.i for r in out.orderBy("rank").collect()] == [0, 3, 4, 5, 6]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "d long, w array<string>")
    index = bm25.postings(docs, "d", "w")
    got = {r.d: r for r in bm25.scores(spark.createDataFrame([(7, ["a", "a", "x"])], "q long, w array<string>"), "q", "w", index, "d").collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 4 / 3
    assert got[1].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)), abs=1e-6)
    assert got[2].hits == 1 and 3 not in got


def test_average_rank_and_bins(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (9, 9, 5, 1, 1)], "g int, v double")
    assert sorted(r.r for r in rows.select(topk.average_rank("v", "g").alias("r")).collect()) == [1.5, 1.5, 3, 4.5, 4.5]
    edges = spark.createDataFrame([(n,) for n in (0, 1, 3, 10, 100, 101)], "n long")
    assert [r[0] for r in edges.orderBy("n").select(split.frequency_bucket(F.col("n"))).collect()] == ["0", "1", "2-3", "4-10", "11-100", ">100"]


def test_share_before_the_core(spark):
    choices = spark.createDataFrame([(1, 1, 6), (1, 2, 3), (1, 3, 1)], "region long, place long, n long")
    assert {r.place: r.before for r in places.region_share(choices, "region", "place", "n").collect()} == {1: 0.0, 2: 0.6, 3: 0.9}


def test_recall(spark):
    predicted = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "q long, i long, rank int")
    truth = spark.createDataFrame([(1, 5), (1, 7), (2, 5), (3, None)], "q long, i long")
    assert {r.q: r.recall for r in metrics.recall_per_query(predicted, truth, "q", "i").collect()} == {1: 0.5, 2: 0.0, 3: None}


def test_answer_rules(spark):
    q, x, y = "a" * 16, "0" * 16, "1" * 16
    rows = [(q, f"{x} {x}"), ("b" * 15, x), ("c" * 16, f" {x}"), ("d" * 16, y), ("d" * 16, "zz")]
    asks = spark.createDataFrame([(q,), ("c" * 16,), ("d" * 16,), ("e" * 16,)], "query_id string")
    found = answer.errors(spark.createDataFrame(rows, "query_id string, answer string"), asks, spark.createDataFrame([(x,)], "item_id string"))
    assert {(r.rule, r.query_id[0]) for r in found.collect()} == {
        ("repeated_item", "a"), ("query_format", "b"), ("unknown_query", "b"), ("blanks", "c"), ("not_in_corpus", "d"), ("repeated_query", "d"), ("item_format", "d"), ("missing_query", "e"),
    }


def test_counters_leave_the_held_out_session_out(spark):
    pairs = spark.createDataFrame([(1, 10, 2), (2, 10, 3)], "q long, i long, n_choices long")
    texts = spark.createDataFrame([(1, "t"), (2, "t")], "q long, t string")
    by_text, by_item, _ = labels.counters(pairs.where("q <> 2"), texts, "q", "i", "t")
    assert by_text.collect()[0].text_rows == 2 and by_item.collect()[0].item_choices == 2


def test_text(spark):
    one = spark.createDataFrame([(1, "Ёлка-2 для ДОМА", None)], "k int, t string, e string")
    row = one.select(text.tokens(F.col("t")).alias("t"), text.tokens(F.col("e")).alias("e"), text.without_stop_words(text.tokens(F.col("t"))).alias("w")).first()
    assert (row.t, row.e, row.w) == (["елка", "2", "для", "дома"], [], ["елка", "2", "дома"])
    assert [stem(w) for w in ("красивая", "красивый", "столы", "cat")] == ["красив", "красив", "стол", "cat"]


def test_parameters_and_experience(spark):
    one = spark.createDataFrame([("noise ab 1 2 a x ab 3 c",)], "t string")
    parsed = one.select(params.parse(F.col("t"), ["a", "ab", "c"]).alias("p")).first().p
    assert [(p.key, p.value) for p in parsed] == [("ab", "1 2"), ("a", "x"), ("ab", "3"), ("c", "")]
    texts = ["Меньше года", "3-5 лет", "3–5 лет", "Больше 10 лет", "7 лет", "много"]
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "i int, v array<string>")
    assert [r[0] for r in rows.orderBy("i").select(params.experience_years(F.col("v"))).collect()] == [0.5, 4.0, 4.0, 10.0, 7.0, None]


def test_distance(spark):
    km = spark.range(1).select(numeric.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert km == pytest.approx(6371 * math.pi / 180)


def test_bins_of_null_and_half_precision(spark):
    import numpy as np

    from ferrule.functions import numeric

    rows = spark.createDataFrame([(None,), (0.0,), (1.5,), (1e9,)], "x double")
    assert [r[0] for r in rows.select(numeric.right_closed(F.col("x"), [0, 1, 3], ["0", "1", "2-3", ">3"])).collect()] == [None, "0", "2-3", ">3"]
    x = [0.0, 1 / 3, -2049.0, 65504.0, 65519.0, 65520.0, 6e-8, 2.5e-8, 1e-5, -0.1, 3.14159]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(numeric.half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in x]


def test_history_of_items_and_of_none(spark):
    """Three texts at unit length; a was chosen for two of them, b for the third, c never."""
    from ferrule.operators import dense

    sims = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 0.0), ("q", 2, 0.6)], "query string, text int, sim double")
    chosen = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "item string, text int")
    pairs = spark.createDataFrame([("q", i) for i in "abc"], "query string, item string")
    got = {r["item"]: (r.hist_text_max_sim, r.hist_text_mean_sim, r.hist_n_texts) for r in dense.history(pairs, chosen, sims, "query", "item", "text").collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.6, 0.6, 1), "c": (None, None, 0)}


def test_variants_and_models_that_come_back(spark, tmp_path):
    from ferrule.operators import features, rerank

    assert rerank.VARIANTS["all"] == features.ALL and not set(features.GROUPS["hist"]) & set(rerank.VARIANTS["no_history"])
    rows = spark.createDataFrame([(q, i, int(i % 4 == 0), float(i % 4), None if i % 5 else 1.0) for q in range(20) for i in range(16)], "q long, i long, label int, a double, b double")
    models = rerank.train(rerank.sample(rows, "q", "i", "label", n=10), ["a", "b"], "label", seeds=(1, 2), trees=3, leaf=1)
    rerank.save(models, str(tmp_path))
    top = rerank.rerank(rows, rerank.load(spark, str(tmp_path), 2), ["a", "b"], "q", "i", 4).collect()
    assert len(top) == 80 and all(r.i % 4 == 0 for r in top)
    assert top == rerank.rerank(rows, models, ["a", "b"], "q", "i", 4).collect()


def test_words_and_metadata_sinks(spark, tmp_path):
    from ferrule.operators import sinks

    sinks.write_words(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string"), "w", f"{tmp_path}/w")
    assert [r.word for r in sinks.read_words(spark, f"{tmp_path}/w").collect()] == ["a", "b"]
    sinks.write_metadata({"seed": 13, "n": 5000}, spark, f"{tmp_path}/m")
    assert sinks.read_metadata(spark, f"{tmp_path}/m") == {"n": 5000, "seed": 13}


def test_vectors_are_made_once(spark, tmp_path):
    from ferrule.operators import sinks

    cache, calls = sinks.VectorCache(spark, f"{tmp_path}/v", "k"), []

    def encode(rows):
        calls.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("embedding", F.array(F.col("k").cast("double")))

    assert cache.ensure(spark.createDataFrame([(1,), (2,), (2,)], "k long"), encode).count() == 3
    got = cache.ensure(spark.createDataFrame([(3,), (1,), (None,)], "k long"), encode).collect()
    assert calls == [[1, 2], [3]] and {(r.k, tuple(r.embedding or ())) for r in got} == {(3, (3.0,)), (1, (1.0,)), (None, ())}


def test_strata_choose_one_after_another(spark):
    import hashlib

    rows = [(i, f"t{i % 23}", "abc"[(i * i) % 3 if i % 5 else 2]) for i in range(90)]
    pool = spark.createDataFrame(rows, "q long, t string, s string")
    targets = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "s string, target long")
    got = {(r.q, r.s) for r in split.stratified_pick(pool, targets, ["s"], "q", "t", 13).collect()}
    used, want = set(), set()
    for s in sorted("abc", key=lambda s: (sum(r[2] == s for r in rows), s)):
        n = 0
        for q, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"13|{r[0]}".encode()).hexdigest(), r[0])):
            if t not in used and n < 9:
                used.add(t)
                want.add((q, s))
                n += 1
    assert got == want
