"""Components by star steps and in one task, against a plain search."""

import random

import pytest

from ferrule.llm import components as C
from ferrule.llm.shelf import Shelf


@pytest.mark.parametrize("in_one_task", [0, 10**6])
def test_components_are_those_of_a_plain_search(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(C, "IN_ONE_TASK", in_one_task)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000), (-5, 7)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.c: r.root for r in C.components(spark.createDataFrame(links, "a long, b long"), Shelf(spark, "c")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}
    assert C.components(spark.createDataFrame([], "a long, b long"), Shelf(spark, "c")).isEmpty()
