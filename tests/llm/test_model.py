"""The language model's scores against a plain version of its formula."""

import math
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, kappa):
    order = len(kappa) + 1
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"], train) for i, t, train in rows]
    counts = Counter()
    for _, w, train in texts:
        if train:
            s = ["<s>", *w]
            counts.update(tuple(s[j : j + n]) for n in range(1, order + 1) for j in range(len(s) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    distinct = sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def p(h, w):
        if not h:
            return (counts[(w,)] + 1) / (total + distinct + 1)
        k = kappa[len(h) - 1]
        return (counts[(*h, w)] + k * p(h[1:], w)) / (counts[h] + k)

    out = {}
    for i, w, _ in texts:
        s = ["<s>", *w]
        out[i] = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
    return out


@pytest.mark.parametrize("kappa", [(), (2000.0,), (300.0, 10.0), (50.0, 5.0, 1.0)])
def test_scores_are_those_of_the_formula(spark, monkeypatch, kappa):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 120)
    texts = [None, "", "a b a b a c", "A b a B", "a b a b a c", "c c c c", "new words only", "b a  b\ta", "a", "a b a b a c a b a b", "é É é"]
    rows = [(i, t, i % 3 != 1) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("train"), kappa=kappa).collect()}
    want = by_hand(rows, kappa)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_counts_beyond_32_bits():
    back = lm._unpack_counts(lm._pack_counts(lm.np.array([0, 1, 5_000_000_000], dtype="<u8")))
    assert back.tolist() == [0, 1, 5_000_000_000]


def a_block():
    """About 4 MB of texts, and them as a block."""
    rng = random.Random(8)
    texts = pa.array([" ".join(f"w{int(rng.paretovariate(0.6)) % 200000}" for _ in range(500)) for _ in range(2400)])
    table = pa.table({"id": range(len(texts)), "text": texts, "train": [i % 7 != 2 for i in range(len(texts))]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return texts, pa.record_batch({"block": [0], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def test_words_of_a_block_are_found_in_parts():
    texts, _ = a_block()
    tracemalloc.start()
    lm._words(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * texts.nbytes
    h, at = lm._words(texts)
    whole, begin = lm.W.words(texts)
    assert (h == whole).all() and (at == begin).all()


def test_messages_are_small_and_sums_exact():
    texts, block = a_block()
    order, shards, bits = 3, 2, 50
    (asked,) = lm._ask(order, shards, bits)([block])
    keys, there, at = lm.grams(texts, order, bits)
    entries = sum(len(u) for u, _ in lm._distinct(keys, there))
    assert asked.nbytes < 8 * entries  # keys alone were 8 bytes each, and counts 4
    for s in range(order * shards):
        messages = pa.Table.from_batches([asked]).filter(pa.compute.equal(asked.column("shard"), s))
        answers = lm._answer(pa.concat_tables([messages] * 3))
        assert answers.column("block").to_pylist() == [0, 0, 0, -1]
        once = lm._numbers(messages.column("counts")[0].as_py(), "<u4")
        assert answers.nbytes < 4 * 3 * len(once)  # they were 8 bytes each
        for k in range(3):
            assert (lm._unpack_counts(answers.column("counts")[k].as_py()) == 3 * once.astype("<u8")).all()
