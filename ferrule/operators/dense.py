"""Dense retrieval over given vectors: exact nearest items, similar queries, centroids, histories, negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, unit
from . import topk

#: Vectors of queries that go round at once.
QUERY_SLICE = 2048
#: Of these, as many are multiplied with a batch at a time.
QUERY_BLOCK = 64
#: Vectors of a place in a block.
BLOCK = 1024


def dense_top_k(items: DataFrame, queries: DataFrame, item: str, query: str, vector: str, k: int, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """``query, item, score, rank``: the k items with the largest dot product for each query, ties to smaller items.

    Exact.  The queries go round in slices of bounded size; each task multiplies its items with a slice and passes on
    its own k best, so that only tasks * k rows a query are shuffled and no pairs are made.
    """
    spark = items.sparkSession
    kinds = items.schema[item].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    rows = items.select(item, F.col(vector).cast("array<double>").alias("v")).where("v is not null")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asks = shared.value
            best: list = [None] * len(names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                for lo in range(0, len(names), QUERY_BLOCK):
                    scores = np.round(_products(asks[lo : lo + QUERY_BLOCK], v), digits) + 0.0
                    for i, s in enumerate(scores, lo):
                        # what may be among the first k: ties with the last of them stay until ids decide
                        least = best[i][0][-1] if best[i] is not None and len(best[i][0]) == k else -np.inf
                        if len(s) > k + 1:
                            least = max(least, np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                        keep = np.flatnonzero((s >= least) & (ids != names[i])) if exclude_self else np.flatnonzero(s >= least)
                        s, own = s[keep], ids[keep]
                        if best[i] is not None:
                            s, own = np.concatenate((best[i][0], s)), np.concatenate((best[i][1], own))
                        at = np.lexsort((own, -s))[:k]
                        best[i] = s[at], own[at]
            got = [(names[i], x, float(y)) for i, b in enumerate(best) if b is not None for y, x in zip(*b, strict=True)]
            if got:
                q, x, y = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(y)], names=[query, item, "score"])

        return run

    def _products(asks: np.ndarray, v: np.ndarray) -> np.ndarray:
        # one component after another, so that the sum does not depend on how rows are batched
        total = np.zeros((len(asks), len(v)))
        for j in range(v.shape[1]):
            total += asks[:, j, None] * v[:, j]
        return total

    out = None
    for names, asks in _slices(queries.select(query, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull())):
        part = rows.mapInArrow(scan(spark.sparkContext.broadcast((names, asks))), f"`{query}` {kinds[1]}, `{item}` {kinds[0]}, score double")
        part = topk.top_k(part, query, "score", item, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"`{query}` {kinds[1]}, `{item}` {kinds[0]}, score double, rank int")


def _slices(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    names, asks = [], []
    for name, v in queries.toLocalIterator():
        names.append(name), asks.append(v)
        if len(names) == QUERY_SLICE:
            yield np.array(names), np.array(asks)
            names, asks = [], []
    if names:
        yield np.array(names), np.array(asks)


def pool_scores(pairs: DataFrame, items: DataFrame, queries: DataFrame, item: str, query: str, vector: str, digits: int = 6) -> DataFrame:
    """``pairs`` with ``score``, the dot product of the pair's vectors: for pools that an equi-join has found."""
    q = queries.select(query, F.col(vector).alias("__q"))
    return pairs.join(q, query).join(items.select(item, F.col(vector).alias("__v")), item).withColumn("score", F.round(dot(F.col("__q"), F.col("__v")), digits)).drop("__q", "__v")


def vector_sum(rows: DataFrame, by: str | list[str], vector: str, weight: Column, into: str) -> DataFrame:
    """``by, into``: the weighted sum of a group's vectors at length 1; added up per component before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    parts = rows.select(*by, weight.cast("double").alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    sums = parts.groupBy(*by, "__i").agg(F.sum(F.col("__x").cast("double") * F.col("__w")).alias("__s"))
    whole = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]).alias(into))
    return whole.withColumn(into, unit(F.col(into)))


def choice_centroids(choices: DataFrame, items: DataFrame, text: str, item: str, vector: str, n: str = "n_choices") -> DataFrame:
    """``text, centroid``: the direction of all the items chosen for a text, each as often as it was chosen."""
    return vector_sum(choices.join(items.select(item, vector), item), text, vector, F.col(n), "centroid")


def neighbour_centroid(neighbours: DataFrame, centroids: DataFrame, query: str, text: str, sim: str = "score") -> DataFrame:
    """``query, centroid, knn_top_sim`` of a query's nearest texts, weighted by their similarity where that is above zero."""
    rows = neighbours.join(centroids.select(text, "centroid"), text)
    mixed = vector_sum(rows, query, "centroid", F.greatest(F.col(sim), F.lit(0.0)), "mixed").withColumnRenamed("mixed", "centroid")
    return mixed.join(neighbours.groupBy(query).agg(F.max(sim).alias("knn_top_sim")), query)


def neighbour_categories(neighbours: DataFrame, shares: DataFrame, query: str, text: str, category: str, sim: str = "score") -> DataFrame:
    """``query, category, share``: the categories of what was chosen for the nearest texts, weighted by similarity."""
    rows = neighbours.join(shares.select(text, category, "share"), text)
    mixed = rows.groupBy(query, category).agg(F.sum(F.greatest(F.col(sim), F.lit(0.0)) * F.col("share")).alias("w"))
    total = F.sum("w").over(Window.partitionBy(query))
    return mixed.select(query, category, (F.col("w") / F.greatest(total, F.lit(1e-6))).alias("share"))


def history(pairs: DataFrame, chosen: DataFrame, sims: DataFrame, query: str, item: str, text: str) -> DataFrame:
    """``pairs`` with the similarity of the query to the texts for which the item was chosen.

    ``hist_text_max_sim`` and ``hist_text_mean_sim`` are null and ``hist_n_texts`` 0 for an item that never was.
    ``sims (query, text, sim)`` has the similarities; ``chosen (item, text)`` what was chosen for what.
    """
    rows = pairs.select(query, item).join(chosen.select(item, text).distinct(), item).join(sims, [query, text])
    seen = rows.groupBy(query, item).agg(F.max("sim").alias("hist_text_max_sim"), F.avg("sim").alias("hist_text_mean_sim"), F.count("*").alias("hist_n_texts"))
    return pairs.join(seen, [query, item], "left").fillna(0, ["hist_n_texts"])


def place_top_k(asks: DataFrame, items: DataFrame, place: str, ask: str, item: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """``ask, item, score, rank``: the k most similar items of the asking vector's own place, itself left out.

    Both sides of a place are cut into blocks of about BLOCK vectors, and a task multiplies one with one: no pairs are
    made, and no place is in one task.
    """
    blocks = lambda df: df.groupBy(place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    sizes = blocks(asks).withColumnRenamed("k", "ka").join(blocks(items).withColumnRenamed("k", "ki"), place)
    in_block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = F.transform(vector, lambda x: x.cast("double")).alias("v")
    left = asks.where(F.col(vector).isNotNull()).join(sizes, place).select(F.col(place).alias("p"), in_block(ask, "ka").alias("i"), each("ki").alias("j"), F.col(ask).alias("id"), F.col(item).alias("own"), v)
    right = items.where(F.col(vector).isNotNull()).join(sizes, place).select(F.col(place).alias("p"), each("ka").alias("i"), in_block(item, "ki").alias("j"), F.col(item).alias("id"), v)
    kinds = asks.schema[ask].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids, names, own = (t.column(c).to_numpy() for t, c in ((b, "id"), (a, "id"), (a, "own")))
            x, y = (np.stack(t.column("v").to_numpy()) for t in (a, b))
            scores = np.zeros((len(x), len(y)))
            for j in range(x.shape[1]):  # in one order, so that the sum does not depend on the blocks
                scores += x[:, j, None] * y[:, j]
            scores = np.round(scores, digits) + 0.0
            for name, mine, s in zip(names, own, scores, strict=True):
                keep = np.flatnonzero(ids != mine)
                at = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
                out += [(name, i, z) for i, z in zip(ids[at].tolist(), s[at].tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        types = a.schema.field("id").type, b.schema.field("id").type, pa.float64()
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["ask", "item", "score"])

    pairs = left.groupBy("p", "i", "j").cogroup(right.groupBy("p", "i", "j")).applyInArrow(best, f"ask {kinds[0]}, item {kinds[1]}, score double")
    return topk.top_k(pairs, "ask", "score", "item", k).withColumnsRenamed({"ask": ask, "item": item})


def hard_negatives(pairs: DataFrame, items: DataFrame, item: str, place: str, text: str, vector: str, known: DataFrame, least: int = 40, top: int = 40, first: int = 5, last: int = 30, seed: int = 13) -> DataFrame:
    """``pairs`` with ``negative``: an item of the same place that is like the chosen one, but was not chosen for the text.

    Of the ``top`` most similar of a place with more than ``least`` items, those chosen for the text are taken out, and
    of the ranks from ``first`` (from 0) to before ``last`` one is picked by hash.  null where there is none.
    """
    crowd = items.groupBy(place).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(place)
    there = items.select(item, place, vector).join(crowd, place, "left_semi")
    asks = pairs.select(item).distinct().join(there, item).withColumn("__ask", F.col(item))
    near = place_top_k(asks, there, place, "__ask", item, vector, top).select("__ask", F.col(item).alias("negative"), "score")
    near = pairs.select(text, item).distinct().join(near.withColumnRenamed("__ask", item), item)
    free = near.join(known.select(text, F.col(item).alias("negative")).distinct(), [text, "negative"], "left_anti")
    band = topk.top_k(free, [text, item], "score", "negative", last).where(F.col("rank") > first)
    w = Window.partitionBy(text, item).orderBy(topk.hash_order(seed, text, item, "negative"), "negative")
    picked = band.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(text, item, "negative")
    return pairs.join(picked, [text, item], "left")
