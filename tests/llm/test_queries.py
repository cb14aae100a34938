"""The registered queries at the smallest size, against SQL or a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from ferrule.llm import decontaminate, queries
from tests.oracle import SF, assert_same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def components(docs, k):
    """id to (size of its set, smallest id it reaches), by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def bpe():
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def test_op2_is_the_library(spark, docs, bpe):
    want = {}
    for i, t in docs:
        ids = bpe.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_byte_bpe(spark, SF).collect()} == want


def test_op4_held_out_accuracy(spark):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_piece_language(spark, SF).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    long = [r for r in rows if r.held_out and lang[r.doc_id][0] and len(lang[r.doc_id][1] or "") >= 200]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in long) >= 0.95 * len(long) > 0


def test_op5_texts_hold_no_markup(spark):
    rows = queries.op5_html_wrappers(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "<div" not in r.text and "<p" not in r.text for r in rows)
    assert sum(r.n_chars > 0 for r in rows) >= 0.9 * len(rows)


def test_op6_is_the_library(spark, docs):
    tok, start, want = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for i, t in sorted(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_file(spark, SF).collect()} == want


def test_op8_base_score_and_a_better_model(spark, docs):
    train = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i, t in docs if i in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in queries.op8_backoff_lm(spark, SF).collect()}
    assert rows.keys() == {i for i, _ in docs}
    for i, t in docs:
        w, r = [*words(t), None], rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op9_finds_what_is_there_word_for_word(spark, docs):
    def plain(t):
        return " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "

    bench = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in docs for j, b in bench if len(b.split()) >= 8 and b in plain(t)}
    found = {(r.doc_id, r.item_id) for r in queries.op9_spaced_seeds(spark, SF).collect()}
    assert want and want <= found


def test_op10_is_all_pairs(spark, docs):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_minhash_near(spark, SF).collect()} == components(docs, 4)


def test_pipeline(spark, docs, bpe):
    """Against all pairs and the library; the language stage by its rule, the benchmark's by its own operator."""
    spoken = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    first = {i for i, (_, least) in components(spoken, 5).items() if i == least}
    table = spark.createDataFrame([(i, t) for i, t in spoken if i in first], "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.overlaps(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    text = dict(docs)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows.keys() == first - leaks
    for i, r in rows.items():
        assert r.ids == bpe.encode_ordinary(text[i]) and r.decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()
