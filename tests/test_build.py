"""The tables of a run from a few raw rows."""

from ferrule.operators import dataset

ITEM = "item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_category_id long, item_price double, item_rating_reviews_count double, item_location_id long, item_latitude double, item_longitude double, pos long"
SEARCH = "search_query string, search_location_id long, search_is_delivery_search int, search_infm_params_text string, search_category long"


def items(spark):
    same = "Одинаковое описание услуги, достаточно длинное, чтобы считаться повтором"
    corpus = [
        ("a", "Ремонт кранов", same, "Вид услуги Сантехника Тип услуги Ремонт Услуга Кран", 114, 500.0, 3.0, 1, 55.0, 37.0, 0),
        ("b", "Уроки", same, "Вид услуги Обучение", 114, 0.0, None, 1, 55.2, 37.2, 1),
    ]
    log = [("a", "Старое имя", "x", None, 114, 1.0, 0.0, 1, 55.0, 37.0, 0), ("c", "Вывоз", "кратко", None, 5, 2e8, 0.0, 2, 56.0, 38.0, 1), ("c", "Другое", "кратко", None, 5, 1.0, 0.0, 2, 56.0, 38.0, 2)]
    return dataset.build_items(spark.createDataFrame(corpus, ITEM), spark.createDataFrame(log, ITEM))


def test_items(spark):
    rows = {r.item_id: r for r in items(spark).collect()}
    assert rows.keys() == {"a", "b", "c"} and (rows["a"].item_title_raw, rows["c"].item_title_raw) == ("Ремонт кранов", "Вывоз")
    assert [rows[i].in_corpus for i in "abc"] == [True, True, False]
    assert [rows[i].price_clean for i in "abc"] == [500.0, None, None]
    assert [rows[i].desc_dup_count for i in "abc"] == [2, 2, 1]
    assert (rows["a"].vid, rows["a"].tip, rows["a"].price_list, rows["c"].vid) == ("Сантехника", "Ремонт", "Кран", "")
    assert [rows[i].is_services_category for i in "abc"] == [True, True, False] and rows["b"].log_reviews == 0


def test_texts_without_stop_words_as_stems(spark):
    rows = {r.item_id: r for r in dataset.build_texts(items(spark)).collect()}
    assert rows["a"].title_stems == ["ремонт", "кран"]
    assert rows["a"].params_stems == ["сантехник", "ремонт", "кран"] and rows["c"].params_stems == []


def test_queries_and_pairs(spark):
    search = ("починить кран", 1, 0, "Вид услуги Сантехника", 114)
    train = spark.createDataFrame([(*search, "a", 0), (*search, "a", 1), (*search, "b", 2), ("вывоз", 9, 0, None, 5, "c", 3)], f"{SEARCH}, item_id string, pos long")
    bench = spark.createDataFrame([("q1", "уроки", 2, 0, None, 114)], f"query_id string, {SEARCH}")
    queries, pairs = dataset.build_queries(train, bench, items(spark))
    rows = {r.search_query: r for r in queries.collect()}
    assert len(rows) == 3 and pairs.count() == 3
    tap, away, school = rows["починить кран"], rows["вывоз"], rows["уроки"]
    assert (tap.source, tap.n_relevant, tap.n_choices, tap.f_vid, tap.loc_level, tap.loc_n_items) == ("train", 2, 3, "Сантехника", "city", 2)
    assert (away.loc_level, away.loc_lat, school.source, school.n_relevant, school.loc_lat) == ("region", None, "bench", None, 56.0)
