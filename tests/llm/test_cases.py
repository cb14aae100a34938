"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import ann, bpe, decontaminate, html, langid, licenses, lm, near, tokenfile, warc
from ferrule.llm.shelf import Shelf

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, label string, path string"
TEXT = "the quick brown fox jumps over the lazy dog and runs far away into the green hills today"


@pytest.fixture(scope="module", params=["some", "none"])
def docs(spark, request):
    texts = [None, "", "  ", TEXT, TEXT, TEXT + " now", "word " * 60_000, "été \U0001f600", "!!!"]
    rows = [(i, t, "en" if i % 2 else None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[3], (None, TEXT, "en", None, None, None, None, None)]
    return spark.createDataFrame(rows if request.param == "some" else [], KIND)


def test_bpe(spark, docs):
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_decoded=True).collect()
    assert len(rows) == docs.count()
    assert all((len(r.ids) == 0) == (len(r.decoded) == 0) for r in rows)


def test_licenses(docs):
    assert licenses.recognise(docs.select("doc_id", "text", "path")).count() == docs.count()


def test_langid(docs):
    rows = langid.predict(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in r.text or ""))


def test_token_file(spark, docs):
    path = Shelf(spark, "t").place()
    tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert tokenfile.read(spark, path).count() == docs.count()


def test_lm(docs):
    assert lm.score(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).count() == docs.count()


def test_overlaps(spark, docs):
    bench = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == ({(3, 1), (4, 1), (5, 1), (None, 1)} if docs.count() else set())
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.where(F.col("text").contains("quick")).isEmpty()
    assert decontaminate.overlaps(docs, bench.limit(0)).isEmpty()


def test_near(docs):
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.component_id == (3 if r.doc_id in (3, 4, 5, None) else r.doc_id) for r in rows)
    left = near.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == ([(False, i) for i in (0, 1, 2, 3, 3, 6, 7, 8)] + [(True, 0)] if rows else [])


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "nothing of this is anywhere in the texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "encoded" or out.columns == docs.columns
        assert out.count() <= docs.count()


@pytest.mark.parametrize("rows", [[], [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, None, None), (4, "", ""), (None, "u", "y")]])
def test_pages(spark, rows):
    pages = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, text string")
    path = Shelf(spark, "w").place()
    warc.write(pages, path)
    found = warc.transactions(warc.records(spark, path)).where("response is not null").collect()
    assert len(found) == len(rows)
    assert {r.response.payload_digest for r in found} == {hashlib.sha1((r[2] or "").encode()).hexdigest() for r in rows}
    assert html.extract(pages).count() == len(rows)


def test_article_without_its_surroundings(spark):
    page = "<html><nav>Menu</nav><article><h1>A &amp; b</h1><p>One  two<br>three</p><aside>Ad</aside></article><script>x</script><footer>End</footer></html>"
    row = html.extract(spark.createDataFrame([(1, "http://a/1", page)], "page_id long, url string, html string")).first()
    assert row.text.split("\n")[0] == "A & b" and all(x not in row.text for x in ("Menu", "Ad\n", "End", "script"))


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(vectors, F.col("vec_id") % 3 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 3 == 0).isEmpty()


def test_decode(spark):
    texts = [(1, "héllo wörld 123"), (2, ""), (None, "null id")]
    ids = bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS).collect()}
    assert got == {i: t.encode() for i, t in texts}
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().decoded) == b""
