"""All features of a few pairs, some of them by hand."""

import math

from pyspark.sql import functions as F

from ferrule.operators import assembly, features


def context(spark):
    queries = spark.createDataFrame(
        [("q1", 1, 114, "city", 55.0, 37.0, "v1", None, "", "plumb", True, "fix tap", ["fix", "tap"], ["job"], ["town"], 2), ("q2", 9, 0, "region", None, None, "", "t2", "au", "", False, "rent", ["rent"], [], [], 1)],
        "query_id string, search_place int, search_category int, loc_level string, loc_lat double, loc_lon double, f_vid string, f_tip string, f_tip_auto string, f_subject string, f_online_booking boolean, text string, q_terms array<string>, "
        "q_intent array<string>, q_toponyms array<string>, q_n_words long",
    )
    rows = []
    for i in range(6):
        flags = {c: i % 2 == 0 for c in [*features.GROUPS["flags"], "work_remote", "travel_city", "online_booking", "phone_hidden", "msg_forbidden"]}
        rows.append(
            {"item_id": f"i{i}", "place": 1 + i % 2, "category": f"c{i % 3}", "lat": 55.0 + i / 100, "lon": 37.0, "vid": f"v{i % 2}", "tip": "t2", "tip_auto": "auto", "subject": "plumbing", "rating": 4.5, "price_list_size": i, "experience_years": 2.0}
            | {"price": float(100 * (i + 1)), "reviews": i, "desc_dup_count": 1, "is_services_category": True, "title": f"Fix tap {i // 4}", "description": "long text", "title_stems": ["fix", "tap"] if i < 3 else ["rent"], "params_stems": ["tap"], "desc_stems": ["fix", "work"]}
            | {"address_stems": ["town"]}
            | flags
        )
    items = spark.createDataFrame(rows)
    vector = lambda a, b: [float(a), float(b)]
    unit = [(1, 0), (0, 1), (0.6, 0.8), (0.8, 0.6), (1, 0), (0, 1)]
    vectors = spark.createDataFrame([(f"i{i}", vector(*u), vector(*u[::-1])) for i, u in enumerate(unit)], "item_id string, embedding array<double>, embedding_user array<double>")
    asked = spark.createDataFrame([("q1", vector(1, 0), vector(0, 1)), ("q2", vector(0, 1), vector(1, 0))], "query_id string, embedding array<double>, embedding_user array<double>")
    table = spark.createDataFrame
    return assembly.Context(
        queries=queries,
        items=items,
        vectors=vectors,
        asked=asked,
        pools=table([("q1", 1, 1.0), ("q1", 2, 0.6), ("q2", 2, 0.8)], "query_id string, place int, mult double"),
        shares=table([(9, 1, 0.95, 0.0, 0), (9, 2, 0.05, 0.95, 1)], "region int, place int, share double, before double, city_rank int"),
        centres=table([(1, 55.0, 37.0, 3), (2, 56.0, 37.0, 3)], "place int, loc_lat double, loc_lon double, loc_n_items int"),
        predicted=table([("q1", "c0", 0.7, 0), ("q1", "c1", 0.3, 1)], "query_id string, category string, p double, category_rank int"),
        text_rows=table([("fix tap", 7)], "text string, text_rows long"),
        item_choices=table([("i0", 3)], "item_id string, item_choices long"),
        text_item_choices=table([("fix tap", "i0", 2)], "text string, item_id string, text_item_choices long"),
        neighbours=table([("q1", "t1", 0.5), ("q1", "t2", 0.25)], "query_id string, text string, score double"),
        centroids=table([("t1", vector(1, 0)), ("t2", vector(0, 1))], "text string, centroid array<double>"),
        neighbour_categories=table([("q1", "c0", 0.9)], "query_id string, category string, share double"),
        chosen=table([("i0", "t1"), ("i0", "t2")], "item_id string, text string"),
        sims=table([("q1", "t1", 1.0), ("q1", "t2", 0.5)], "query_id string, text string, sim double"),
        intents={"job": ["work", "fix"]},
        home=["home"],
        remote=["tap"],
    )


def test_all_features_of_the_candidates(spark):
    candidates = spark.createDataFrame([(q, f"i{i}", i, 500 - i, 500, 300) for q in ("q1", "q2") for i in range(4)], "query_id string, item_id string, rank_bm25 int, rank_dense int, rank_user int, rank_knn int")
    base = spark.createDataFrame([("q1", "i0", 1), ("q1", "i1", 51)], "query_id string, item_id string, rank int")
    out = assembly.assemble(candidates, base, context(spark))
    assert out.columns == ["query_id", "item_id", *features.ALL] and len(features.ALL) == 82
    rows = {(r.query_id, r.item_id): r for r in out.collect()}
    assert len(rows) == 8
    a, b, z = rows["q1", "i0"], rows["q1", "i3"], rows["q2", "i1"]
    close = lambda x, y: math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-6)
    assert (a.in_base50, rows["q1", "i1"].in_base50, a.rank_bm25, a.rank_dense, a.rank_knn) == (1, 0, 0, 500, 300)
    assert (a.cos, a.cos_user, a.cos_gap_max, rows["q1", "i1"].cos_user_gap_max) == (1, 1, 0, -1)
    assert close(a.knn_cos_centroid, 0.5 / math.hypot(0.5, 0.25)) and (a.knn_cos_max, a.knn_top_sim) == (1, 0.5)
    assert (a.all_in_title, a.bigram_title, a.cov_all, b.all_in_title, b.cov_title, b.bigram_title) == (1, 1, 1, 0, 0, 0)
    assert z.bigram_title == -1 and close(a.bm25_rel_max, max(1.0, a.bm25_rel_max))
    assert close(a.geo_mult, 1) and close(b.geo_mult, 0.6) and (a.same_city, b.same_city, a.dist_km) == (1, 0, 0) and z.dist_km is None
    assert close(b.city_center_dist_km, 6371 * math.radians(1)) and close(z.region_city_share, 0.05) and z.region_city_rank == 1
    assert (a.vid_match, b.vid_match, a.tip_match, a.subject_match, z.tip_match, z.tip_auto_match) == (0, 1, -1, 1, 1, 1)
    assert (close(a.microcat_prob, 0.7), a.microcat_rank, rows["q1", "i2"].microcat_rank, z.microcat_rank) == (True, 0, 3, 999)
    assert close(a.log_text_rows, math.log(8)) and close(a.log_item_choices, math.log(4)) and (a.same_text_choices, b.same_text_choices) == (2, 0)
    assert (a.hist_text_max_sim, a.hist_text_mean_sim, a.hist_n_texts, b.hist_text_max_sim, b.hist_n_texts) == (1, 0.75, 2, None, 0)
    assert (a.intent_match, z.intent_match, a.mod_home_match, a.mod_remote_match, a.toponym_in_address, z.toponym_in_address, a.online_booking_match, z.online_booking_match, z.query_cat0) == (1, -1, -1, 1, 1, -1, 1, -1, 1)
    assert (a.title_words, a.desc_chars, a.n_cand, close(a.log_pool, math.log(7)), close(a.knn_microcat_share, 0.9)) == (3, 9, 4, True, True)
    assert (a.twins_city, a.price_missing, a.is_services) == (2, 0, 1) and a.price_rel_city_mc == 1
    assert out.where(F.col("log_pool").isNull()).isEmpty()
