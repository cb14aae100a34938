"""The index of token shards: every stored key is found, others are not."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from ferrule.llm import tokenfile
from ferrule.llm.shelf import Shelf

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    slots = tokenfile.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_lookup_of_absent_null_and_repeated_keys(spark):
    rows = [(i, f"text {i} of many") for i in range(0, 400, 2)] + [(4, "aaa first of its key"), (None, "no key"), (None, None)]
    path = Shelf(spark, "t").place()
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, end_id=2)
    wanted = spark.createDataFrame([(i,) for i in (*range(-3, 405), 4, None)], "doc_id long")
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in sorted(r for r in rows if r[0] is not None)[::-1]}
    want[4] = [*tok.encode("aaa first of its key", add_special_tokens=False).ids, 2]
    found = tokenfile.lookup(spark, path, wanted).collect()
    assert len(found) == len(want) and {r.doc_id: r.ids for r in found} == want
    read = tokenfile.read(spark, path).collect()
    assert sorted((r.key is None, r.key or 0) for r in read) == sorted((i is None, i or 0) for i, _ in rows)


def test_a_fingerprint_or_key_that_differs_is_no_hit():
    keys = np.arange(0, 1000, 7)
    shard = tokenfile.Shard.build(keys, np.zeros(len(keys), bool), np.arange(1, len(keys) + 1), np.arange(len(keys), dtype="<u2"), 0, 0)
    shard = tokenfile.Shard.read(shard.write())
    assert [shard.find(int(k)).tolist() for k in keys] == [[i] for i in range(len(keys))]
    assert all(shard.find(k) is None for k in range(-50, 1100) if k % 7 or not 0 <= k < 1000)


def test_words_are_encoded_as_by_the_library(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_ENTRIES", 300)  # so that words are forgotten now and then
    encoder, tok, rng = tokenfile.WordEncoder(PATH), tokenizers.Tokenizer.from_file(PATH), random.Random(3)
    for _ in range(5):
        texts = ["".join(rng.choice("abcXYZ \u00e9 \u00df \u0130\n\t.,!?;:'\"-_0123 \u4e2d\u6587 \U0001f600\ufb01\u0301 ") for _ in range(rng.randrange(40))) for _ in range(400)] + ["word, Word, \u00c5.", ""]
        ids, ends = encoder.encode(pa.array(texts))
        parts = np.split(ids, ends[:-1])
        assert [p.tolist() for p in parts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
