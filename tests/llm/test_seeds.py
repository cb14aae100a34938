"""Overlaps with the benchmark against all shifts of all pairs, and how many substitutions the masks stand."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ferrule.llm import decontaminate as D
from ferrule.llm import queries
from tests.oracle import SF


def best_shift(doc, item):
    """Equal tokens at the best shift, and the best stretch net of four for each substitution, by comparing all pairs."""
    i, j = np.nonzero(doc[:, None] == item[None, :])
    if not len(i):
        return 0, 0
    shifts = np.unique(i - j)
    best = most = 0
    for s in shifts:
        lo, hi = max(0, -s), min(len(item), len(doc) - s)
        same = doc[s + lo : s + hi] == item[lo:hi]
        best = max(best, int(same.sum()))
        if same.sum() >= D.LONG:
            net = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
            most = max(most, int((net - np.minimum.accumulate(net)).max()))
    return best, most


def test_overlaps_are_those_of_all_shifts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    (h, at), (g, bt) = (D.tokens(pa.array([t for _, t in rows], pa.string())) for rows in (docs, bench))
    maybe, sure = set(), set()
    for x, (i, _) in enumerate(docs):
        doc = h[at[x] : at[x + 1]]
        for y, (j, _) in enumerate(bench):
            item = g[bt[y] : bt[y + 1]]
            if len(item) < D.SHORTEST or not np.isin(item, doc).mean() * len(item) >= min(D.MIN_MATCH, len(item)):
                continue
            n, net = best_shift(doc, item)
            if (n >= min(D.MIN_MATCH, len(item)) and n >= D.COVER * len(item)) or net >= D.LONG:
                maybe.add((i, j))
                if n >= 0.8 * len(item) or net >= 2 * D.LONG:
                    sure.add((i, j))
    found = {(r.doc_id, r.item_id) for r in queries.op9_spaced_seeds(spark, SF).collect()}
    assert sure and sure <= found <= maybe


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.1, 0.995), (0.2, 0.97), (0.3, 0.9)])
def test_substitutions(share, least):
    rng = random.Random(int(100 * share) + 1)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(400)]
    index = D.Index(list(range(400)), pa.array([" ".join(w) for w in items]))
    texts = []
    for w in items:
        w = list(w)
        for p in rng.sample(range(40), round(40 * share)):
            w[p] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join([f"y{rng.randrange(10**6)}" for _ in range(60)] + w + [f"z{rng.randrange(10**6)}" for _ in range(30)]))
    found = {(d, i) for d, i, *_ in index.overlaps(pa.array(texts))}
    assert all(d == i for d, i in found) and len(found) >= least * 400


def test_part_of_a_long_item_and_other_scripts():
    rng = random.Random(9)
    item = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    han = "今天天气很好我们去公园散步吧"
    index = D.Index([0, 1, 2], pa.array([" ".join(item), han, "one’s own “quoted” words are here to be found again"]))
    texts = ["before " + " ".join(item[90:120]) + " after", "before " + " ".join(item[90:105]) + " after", "【" + han + "】", "one's own 'quoted' words are here to be found again"]
    assert {(d, i) for d, i, *_ in index.overlaps(pa.array(texts))} == {(0, 0), (2, 1), (3, 2)}
