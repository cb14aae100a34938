"""Connected components of a distributed list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shelf import Shelf

#: Up to this many links are followed in one task, which has 16 bytes for each; more are in star steps.
IN_ONE_TASK = 500_000


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """``c, root`` for every node of ``links (a, b)``, longs: root is the smallest node that c is linked with, over any way.

    Each step links a node's neighbours with the smallest of them.  Nodes are compared, never collected; a node
    with very many neighbours is a key of a join that adaptive execution splits.  Stops when a step changes nothing.
    """
    now = shelf.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= IN_ONE_TASK:
        out = shelf.put(now.coalesce(1).mapInArrow(_follow, "c long, root long"))
        shelf.drop(now)
        return out
    seen = None
    while True:
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = shelf.put(moved.union(small.select("u", F.col("m").alias("v"))).distinct())
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        shelf.drop(now)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("c"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), strict=True)) or [[], []]))
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (further := new[new] != new).any():
            new[further] = new[new[further]]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["c", "root"])
