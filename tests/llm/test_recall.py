"""Recall of the quantised search where the shortlist is a small share of the rows."""

import os
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ferrule.llm import ann


def test_recall_at_ten_against_brute_force(spark):
    """6000 vectors around 60 centres; each query reranks 200 of them, 3 %."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 32))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.search(rows, F.col("vec_id") % 100 == 0, shortlist=200).collect()
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(6000), d))[:10]
        got = {r.vec_id: r.score for r in found if r.query_id == q}
        assert len(got) == 10 and all(abs(got[i] - d[i]) < 1e-9 for i in got)
        hits += len(got.keys() & set(want.tolist()))
    assert hits >= 0.9 * 600


def test_ties_beyond_two_and_vectors_of_two_lengths(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 6)] + [(0, [0.0, 1.0]), (6, [0.0, 2.0]), (7, [1.0, 2.0, 3.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in found] == [(1, 6), (2, 1), (3, 2), (4, 3)]


def test_sums_of_codewords_without_their_matrix():
    rng = np.random.default_rng(5)
    codes, x = rng.integers(0, 8, (300, 4)).astype(np.uint8), rng.normal(size=(300, 3)).astype(np.float32)
    u = np.eye(8)[codes].reshape(300, 32)
    both, sums = ann.normal_sums(codes, x, 8)
    assert (both == u.T @ u).all() and np.allclose(sums, u.T @ x)


def test_fitting_holds_no_matrix_of_rows_and_codewords():
    """20,000 rows of 4096 codewords in all would be 330 MB; the sums of pairs of codewords are 134 MB."""
    x = np.random.default_rng(7).normal(size=(20000, 2)).astype(np.float32)
    tracemalloc.start()
    try:
        ann.fit(x, rounds=1)
        assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()


def test_the_driver_does_not_fit(spark, monkeypatch):
    driver, fit = os.getpid(), ann.fit

    def elsewhere(sample):
        assert os.getpid() != driver
        return fit(sample)

    monkeypatch.setattr(ann, "fit", elsewhere)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    found = ann.search(rows, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_sample_of_a_large_table_is_that_of_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 20)
    classes = spark.range(0, 1000, 1, 7).select(F.array("id").alias("v"), F.col("id").alias("c"), F.xxhash64("id").alias("h"))
    sample = ann.sample_of(classes)
    assert sample.rdd.getNumPartitions() == 1
    assert [r.v[0] for r in sample.collect()] == [r.c for r in classes.orderBy("h").limit(20).collect()]
