"""Nearest neighbours by additive quantisation with exact reranking.

A vector is approximated by the sum of one codeword from each of CODEBOOKS full-dimensional codebooks.  These are
fitted on a bounded sample (SAMPLE distinct vectors, those with the smallest hashes): first on the residuals of one
another, then by least squares against the codes that the encoder finds, whose sums are counted from the codes.  One
task fits them; the driver gets the codebooks alone.  Every vector is encoded by a beam search that keeps the BEAM best
partial sums, and stored as its codes and the squared norm of its approximation.

A query makes a table of its inner products with all codewords.  A stored vector's distance is then its norm less
twice the sum of CODEBOOKS table entries.  Each task keeps its SHORTLIST best for each query, the best of all tasks
are reranked by the exact distance on the original vectors in double precision.

Equal vectors are one entry with their smallest ids, so copies neither fill the shortlist nor weigh on a task.  The
queries are a stated set against all rows; they go round in slices of QUERY_SLICE vectors, which bounds what is
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shelf import Shelf, bounded_batches, frugal

CODEBOOKS = 32
WORDS = 128
BEAM = 8
SAMPLE = 16384
SHORTLIST = 512
QUERY_SLICE = 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each row of x: all codebooks in turn, keeping the best partial sums."""
    out = np.empty((len(x), len(books)), dtype=np.uint8)
    for s in range(0, len(x), 1024):
        v = x[s : s + 1024]
        n, k = len(v), books.shape[1]
        rest, codes, cost = v[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8), (v * v).sum(1)[:, None]
        for book in books:
            new = cost[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
            flat = new.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // k, best % k
            rows = np.arange(n)[:, None]
            cost = flat[rows, best]
            rest = rest[rows, parent] - book[word]
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
        out[s : s + 1024] = codes[np.arange(n), cost.argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit(sample: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 3) -> np.ndarray:
    """Codebooks as an array (codebook, word, dimension)."""
    rng = np.random.default_rng(17)
    books = np.zeros((codebooks, words, sample.shape[1]), dtype=np.float32)
    if not len(sample):
        return books
    rest = sample.astype(np.float32)
    for m in range(codebooks):
        books[m] = _kmeans(rest, words, rng)
        rest = rest - books[m][(-2 * rest @ books[m].T + (books[m] ** 2).sum(1)).argmin(1)]
    for _ in range(rounds):
        both, sums = normal_sums(beam_encode(sample, books), sample, words)
        pull = 0.01  # towards the present codewords, so that unused ones stay
        both.flat[:: len(both) + 1] += pull
        sums += pull * books.reshape(sums.shape)
        books = np.linalg.solve(both, sums).reshape(books.shape).astype(np.float32)
        del both  # before the next round makes another
    return books


def normal_sums(codes: np.ndarray, x: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows have both of two codewords, for each two, and the sum of the rows of x that have a codeword.  These
    are u'u and u'x, where u has a 1 for each codeword of a row, but u is never made."""
    n, codebooks = codes.shape
    codes = codes.astype(np.intp)
    both = np.zeros((codebooks, words, codebooks, words))  # in the double precision that solve would copy it to
    sums = np.zeros((codebooks, words, x.shape[1]))
    for m in range(codebooks):
        for o in range(m, codebooks):
            pairs = np.bincount(codes[:, m] * words + codes[:, o], minlength=words * words).reshape(words, words)
            both[m, :, o], both[o, :, m] = pairs, pairs.T
        for j, column in enumerate(x.T):
            sums[m, :, j] = np.bincount(codes[:, m], column, words)
    return both.reshape(codebooks * words, -1), sums.reshape(codebooks * words, -1)


def sample_of(classes: DataFrame) -> DataFrame:
    """The SAMPLE rows of the smallest hashes ``h``, in one partition.  Of a large table, only hashes among which twice as
    many are expected are sorted, so the one task doesn't get SAMPLE rows from every other."""
    n = classes.count()
    some = classes.where(F.col("h") < (2 * SAMPLE << 64) // n - (1 << 63)) if n > 4 * SAMPLE else classes
    return some.select("v", "c", "h").orderBy("h", "c").limit(SAMPLE).select("v")


def fit_in_task(sample: DataFrame, d: int) -> np.ndarray:
    """fit() on the vectors of a table of one partition, outside the driver."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).flatten().to_numpy().astype(np.float32).reshape(-1, d) for b in batches]
        for m, book in enumerate(fit(np.concatenate([np.empty((0, d), np.float32), *parts]))):
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([book.tobytes()], pa.binary())], names=["m", "book"])

    books = sorted(sample.mapInArrow(run, "m int, book binary").collect())
    return np.array([np.frombuffer(r.book, dtype=np.float32).reshape(-1, d) for r in books])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part: ids and vectors not null, all components finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad & some)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shortlist: int = SHORTLIST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query row, nearest first, ties to smaller ids.

    The score is the Euclidean distance in double precision.  Vectors that are null, zero or hold null or non-finite
    components neither ask nor answer, nor do those of another length than most.  Rows with the same id and vector
    are one; an id given with several vectors stands for each.  All candidates are returned where there are fewer than k; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    shelf = Shelf(spark, "ann")
    rows = usable(vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))), id_col, vector_col)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    d = size["d"]
    rows = rows.where(F.size("v") == d)
    # equal vectors: one entry, with as many ids as an answer can need
    key = F.xxhash64("v")
    by = Window.partitionBy("h", "v").orderBy("id")
    few = rows.select("id", "v", key.alias("h")).withColumn("i", F.dense_rank().over(by)).where(F.col("i") <= k + 1)
    classes = shelf.put(few.groupBy("h", "v").agg(F.min("id").alias("c"), F.sort_array(F.collect_set("id")).alias("ids")))
    shared = spark.sparkContext.broadcast(fit_in_task(sample_of(classes), d))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy().astype(np.float32).reshape(-1, d)
            codes = beam_encode(v, shared.value)
            norm = (decode(codes, shared.value).astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], names=["h", "codes", "norm"])

    # an entry is named by the hash of its vector; in the rare case that two share it, both are reranked
    coded = shelf.put(classes.select("h", "v").mapInArrow(encode, "h long, codes binary, norm float"))

    def scan(queries):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = queries.value
            tables = np.einsum("qd,mkd->qmk", vectors, shared.value) if len(ids) else np.zeros((0, 1, 1))
            best = [(np.empty(0, np.float32), np.empty(0, np.int64))] * len(ids)
            for b in batches:
                h = b.column(0).to_numpy()
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(len(h), -1)
                columns, norm = [c.astype(np.intp) for c in codes.T], b.column(2).to_numpy()
                for q, t in enumerate(tables):
                    far = norm - 2 * sum(t[m][c] for m, c in enumerate(columns))
                    near = np.argpartition(far, shortlist)[:shortlist] if len(far) > shortlist else np.arange(len(far))
                    a, i = np.concatenate((best[q][0], far[near])), np.concatenate((best[q][1], h[near]))
                    first = np.lexsort((i, a))[:shortlist]
                    best[q] = a[first], i[first]
            if len(ids) and len(best[0][0]):
                at = np.cumsum([0] + [len(a) for a, _ in best]).astype(np.int32)
                both = pa.StructArray.from_arrays([pa.array(np.concatenate([a for a, _ in best]), pa.float32()), pa.array(np.concatenate([i for _, i in best]), pa.int64())], names=["far", "h"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), both)], names=["q", "near"])

        return run

    asks = rows.where(F.col("id").isNotNull()).join(vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    asks = shelf.put(asks.distinct().withColumn("q", F.xxhash64("id", "v")))
    merged = None
    merge = lambda df, *by: df.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, shortlist).alias("near"))
    for ids, part in _slices(asks, d):
        found = coded.mapInArrow(scan(spark.sparkContext.broadcast((ids, part))), "q long, near array<struct<far: float, h: long>>")
        found = merge(merge(found.withColumn("s", F.spark_partition_id() % 64), "q", "s"), "q")
        merged = found if merged is None else merged.unionByName(found)
    if merged is None:
        return spark.createDataFrame([], schema)
    pairs = merged.select("q", F.explode("near.h").alias("h")).join(asks.select("q", F.col("id").alias("query_id"), F.col("v").alias("u")), "q")
    steps = F.zip_with("u", "v", lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(steps, F.lit(0.0), lambda a, b: a + b))
    exact = pairs.join(classes.select("h", "v", "ids"), "h").select("query_id", distance.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    # an id that was given with several vectors answers with its nearest
    exact = exact.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _slices(asks: DataFrame, d: int) -> Iterator[tuple[list[int], np.ndarray]]:
    ids, part = [], []
    for r in asks.select("q", "v").toLocalIterator():
        ids.append(r[0]), part.append(np.array(r[1], dtype=np.float32))
        if len(ids) == QUERY_SLICE:
            yield ids, np.array(part)
            ids, part = [], []
    if ids:
        yield ids, np.array(part).reshape(-1, d)
