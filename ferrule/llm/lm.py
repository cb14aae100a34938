"""Language-model scoring by a weighted backoff automaton over the words of a corpus.

Model: n-gram counts of all training texts, smoothed from order to order by a Dirichlet prior of weight KAPPA[n],

    p(w | h) = (c(h w) + KAPPA[n] * p(w | h')) / (c(h) + KAPPA[n]),    p(w) = (c(w) + 1) / (N + V + 1),

where h' is h without its first word.  Each seen context is a state.  A state has an arc for each word seen
after it, and one failure arc, of weight KAPPA[n] / (c(h) + KAPPA[n]), to the state of h'.  The product of the failure
weights and the arc's weight is p, so scoring is one walk from left to right that carries the state.

The model grows with the corpus and is never in one place.  Texts are packed into blocks, compressed; a block asks for
the counts of its own distinct n-grams, in one sorted, compressed message to each shard of the key space, with its own
training counts; a shard adds up what all blocks have sent and answers each in the order of its question.  A block then
builds the part of the automaton that its texts can reach, which is exact, and walks it.  A frequent n-gram costs
one entry a block, so no key is hot.  Blocks and answers are written to the shared folder: a lost executor repeats a
block or a shard only.

Words have 64-bit keys.  Those of longer n-grams have SPARE bits more than are needed to number the corpus' bytes, so
that about one n-gram in 2**SPARE shares its count with another, at any size of the corpus.

Blocks and shards have a bounded size, so there are as many messages as one has of them times the other: beyond some
TB, BLOCK_BYTES and SHARD_BYTES are to be raised with the executors' memory.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shelf import Shelf, bounded_batches, frugal, frugally, hand_back

#: Weights of the priors of orders 2 and up; their number gives the model's order.
KAPPA = (1000.0, 50.0)
#: Text bytes in a block and for each shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
#: Least number of shards.
SHARDS = 24
SPARE = 20
_U = np.uint64
END, START = (W.mix(np.array([i], dtype=_U))[0] for i in (0xE0D, 0x57A27))


def _longer(before: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the n-grams that are one token longer."""
    return W.mix(before * _U(W._BASE) + token) >> _U(64 - bits)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """W.words, of a part of the texts at a time: it holds some 40 bytes for each byte of its texts."""
    parts = [W.words(texts.slice(a, b - a)) for a, b in W.blocks(texts)] or [W.words(texts)]
    begin = np.cumsum([0] + [len(h) for h, _ in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([*(at[:-1] + b for (_, at), b in zip(parts, begin, strict=False)), begin[-1:]])


def grams(texts: pa.Array, order: int, bits: int = 64) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to the order; where they exist; where texts begin.

    A text's tokens are its words and one end; n-grams may begin with the start, but not before it.
    """
    h, at = _words(texts)
    docs = len(texts)
    at = at + np.arange(docs + 1)
    tokens = np.empty(len(h) + docs, dtype=_U)
    last = np.zeros(len(tokens), dtype=bool)
    last[at[1:] - 1] = True
    tokens[last], tokens[~last] = END, h
    keys, there = [tokens], [np.ones(len(tokens), dtype=bool)]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before, ok = np.empty_like(tokens), np.zeros(len(tokens), dtype=bool)
            before[1:], ok[1:] = keys[-1][:-1], there[-1][:-1]
            before[at[:-1]], ok[at[:-1]] = START, n == 2
            keys.append(_longer(before, tokens, bits))
            there.append(ok)
    return keys, there, at


def _distinct(keys: list[np.ndarray], there: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct keys of each order, and the positions' places among them."""
    out = []
    for i, (k, ok) in enumerate(zip(keys, there, strict=True)):
        u, at = np.unique(np.append(k, START) if i == 0 else k[ok], return_inverse=True)
        out.append((u, at.astype(np.int32)))
    return out


def _cuts(sorted_keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    edges = np.array([-(-(i << bits) // shards) for i in range(shards)], dtype=object)
    return np.append(np.searchsorted(sorted_keys, edges.astype(_U)), len(sorted_keys))


def _planes(numbers: np.ndarray) -> bytes:
    """Byte plane by byte plane, as the high planes are nearly all zero, and compressed: so Spark's buffers, sorts and
    readers never hold a message in full.  What it takes when unpacked comes first."""
    data = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    planes = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Differences of the keys."""
    steps = sorted_keys.copy()
    steps[1:] -= sorted_keys[:-1]
    return _planes(steps)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, "<u8"), dtype=_U)


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bytes, rows) of rows (id, text, train): a block's rows as a compressed table of their own."""
    task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        whole = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | n]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "rows"])

    for batch in batches:
        for a, b in W.blocks(batch.column(1), BLOCK_BYTES // 4):
            part = batch.slice(a, b - a)
            held.append(part)
            size += int(W.buffer(part.column(1))[1][-1])
            if size >= BLOCK_BYTES:
                yield block()
                n, held, size = n + 1, [], 0
    if held:
        yield block()


def _unpacked(data: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(data.as_buffer()) as stream:
        return stream.read_all().combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _pack_counts(counts: np.ndarray) -> bytes:
    """64-bit counts."""
    return _planes(counts)


def _unpack_counts(data: bytes) -> np.ndarray:
    return _numbers(data, "<u8")


def _ask(order: int, shards: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield of(b, _unpacked(data))

    def of(b: int, block: pa.Table) -> pa.RecordBatch:
        train = block.column("train").to_numpy().astype(bool)
        keys, there, at = grams(_one(block.column("text")), order, bits)
        weight = np.repeat(train, np.diff(at))
        rows: list[tuple] = []
        for n, (u, place) in enumerate(_distinct(keys, there)):
            w = weight[there[n]].astype(np.float64)
            if n == 0:
                w = np.append(w, train.sum())  # the start comes before each training text
            count = np.bincount(place, weights=w, minlength=len(u)).astype("<u4")
            cut = _cuts(u, shards, bits if n else 64)
            rows += [(b, n + 1, n * shards + s, _pack(u[x:y]), _planes(count[x:y])) for s, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "shard", "keys", "counts"])

    return run


def _answer(messages: pa.Table) -> pa.Table:
    return frugally(_sums, messages)


def _sums(messages: pa.Table) -> pa.Table:
    """For each message, the sums over all messages; block -1 has the numbers of training tokens and of distinct ones."""
    blocks, order, shard = (messages.column(i).to_pylist() for i in range(3))
    keys = [_unpack(x.as_py()) for x in messages.column(3)]
    ends = np.cumsum([0] + [len(k) for k in keys])
    keys = np.concatenate(keys)
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.concatenate([_numbers(x.as_py(), "<u4") for x in messages.column(4)])
    total = np.add.reduceat(count[by], first, dtype="<u8")
    words = np.where(keys[first] == START, 0, total) if order[0] == 1 else np.zeros(1)
    del keys, count
    sums = np.empty(len(by), "<u8")
    sums[by] = np.repeat(total, np.diff(first, append=len(by)))
    out = [_pack_counts(sums[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.Table.from_arrays(
        [
            pa.array([*blocks, -1], pa.int64()),
            pa.array([*order, 0], pa.int32()),
            pa.array([*shard, 0], pa.int32()),
            pa.array([*out, b""], pa.binary()),
            pa.array([*[0] * len(out), int(words.sum())], pa.int64()),
            pa.array([*[0] * len(out), int((words > 0).sum())], pa.int64()),
        ],
        names=["block", "n", "shard", "counts", "tokens", "distinct"],
    )


class Automaton:
    """States 0 (the root) and one for each seen context; arcs in the order of their n-gram's key."""

    def __init__(self, there: list[np.ndarray], distinct: list, counts: list[np.ndarray], total: int, vocabulary: int, kappa: tuple[float, ...], bits: int):
        order, self.bits = len(distinct), bits
        known = [c > 0 for c in counts]
        # states: the seen grams shorter than the order, after the root
        base = np.concatenate(([1], 1 + np.cumsum([k.sum() for k in known[:-1]]))).astype(np.int64)
        self.state = [np.where(k, b + np.cumsum(k) - 1, 0) for k, b in zip(known[:-1], base, strict=False)]
        n = int(base[-1]) if order > 1 else 1
        self.fail, self.fail_weight, self.context = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=_U)
        p = (counts[0] + 1.0) / (total + vocabulary + 1)
        self.unknown = float(np.log10(1.0 / (total + vocabulary + 1)))
        self._fill(there, distinct, counts, known, kappa, p)
        by = np.argsort(self.arcs[0], kind="stable")
        for i in range(len(self.arcs)):
            self.arcs[i] = self.arcs[i][by]
        found = np.flatnonzero(self.context == START)
        self.begin = int(found[0]) if len(found) else 0

    def _fill(self, there: list[np.ndarray], distinct: list, counts: list[np.ndarray], known: list[np.ndarray], kappa: tuple[float, ...], p: np.ndarray) -> None:
        """States and arcs, order by order; p is that of the first."""
        order = len(distinct)
        ends = np.cumsum([0] + [int(k.sum()) for k in known])
        self.arcs = [np.empty(ends[-1], kind) for kind in (_U, np.float64, np.int64)]
        for i in range(order):
            u, place = distinct[i]
            if i:
                where = np.flatnonzero(there[i])
                example = np.empty(len(u), dtype=np.int64)
                example[place] = where
                shorter = self._places(distinct, there, i - 1)
                suffix = shorter[example]
                before = np.where(example > 0, shorter[example - 1], 0)
                if i == 1:  # the text's first token comes after the start
                    first = np.isin(example, self._starts)
                    before[first] = np.searchsorted(distinct[0][0], START)
                h = counts[i - 1][before].astype(np.float64)
                p = (counts[i] + kappa[i - 1] * p[suffix]) / (h + kappa[i - 1])
                follow = suffix
            else:
                follow = np.arange(len(u))
            if i < order - 1:
                s = self.state[i][known[i]]
                self.context[s] = u[known[i]]
                self.fail_weight[s] = np.log10(kappa[i] / (counts[i][known[i]] + kappa[i]))
                self.fail[s] = 0 if i == 0 else self.state[i - 1][follow[known[i]]]
                to = self.state[i]
            else:
                to = self.state[i - 1][follow] if order > 1 else np.zeros(len(u), dtype=np.int64)
            for arc, values in zip(self.arcs, (u, np.log10(p), to), strict=True):
                arc[ends[i] : ends[i + 1]] = values[known[i]]

    _starts: np.ndarray

    @classmethod
    def of_block(cls, there, at, distinct, counts, total, vocabulary, kappa, bits) -> Automaton:
        self = cls.__new__(cls)
        self._starts = at[:-1]
        self.__init__(there, distinct, counts, total, vocabulary, kappa, bits)
        return self

    @staticmethod
    def _places(distinct: list, there: list[np.ndarray], i: int) -> np.ndarray:
        out = np.zeros(len(there[i]), dtype=np.int32)
        out[there[i]] = distinct[i][1][: int(there[i].sum())]
        return out

    def score(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of each text's probability: all texts are walked together, each carrying its own state."""
        keys, weights, to = self.arcs
        sizes = np.diff(at)
        by = np.argsort(-sizes, kind="stable")
        begin, left = at[:-1][by], sizes[by]
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right") if len(left) else []
        state, total = np.full(len(by), self.begin, dtype=np.int64), np.zeros(len(by))
        last = max(len(keys) - 1, 0)
        with np.errstate(over="ignore"):
            for t, n in enumerate(live):
                w, s, gain = tokens[begin[:n] + t], state[:n], total[:n]
                todo = np.arange(n)
                while len(todo):
                    here = s[todo]
                    word = w[todo]
                    key = np.where(here == 0, word, _longer(self.context[here], word, self.bits))
                    i = np.minimum(np.searchsorted(keys, key), last)
                    hit = keys[i] == key if len(keys) else np.zeros(len(todo), dtype=bool)
                    got = todo[hit]
                    gain[got] += weights[i[hit]]
                    s[got] = to[i[hit]]
                    out = ~hit & (here == 0)
                    gain[todo[out]] += self.unknown
                    s[todo[out]] = 0
                    more = ~hit & (here != 0)
                    todo, here = todo[more], here[more]
                    gain[todo] += self.fail_weight[here]
                    s[todo] = self.fail[here]
        result = np.empty(len(by))
        result[by] = total
        return result


def _walk(order: int, shards: int, kappa: tuple[float, ...], total: int, vocabulary: int, bits: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        return frugally(of, block, answers)

    def of(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = _unpacked(_one(block.column("rows"))[0])
        keys, there, at = grams(_one(block.column("text")), order, bits)
        distinct = _distinct(keys, there)
        tokens = keys[0]
        del keys
        hand_back()
        counts = []
        by = sorted(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        for n in range(order):
            got = [_unpack_counts(c) for s, c in by if s // shards == n]
            got = np.concatenate(got) if got else np.empty(0, "<u8")
            if len(got) != len(distinct[n][0]):
                raise ValueError("answers do not fit the block's questions")
            counts.append(got.astype(np.float64))
        model = Automaton.of_block(there, at, distinct, counts, total, vocabulary, kappa, bits)
        known = counts[0][distinct[0][1][:-1]]
        base = np.log10((known + 1.0) / (total + vocabulary + 1))
        begin = at[:-1]
        return pa.Table.from_arrays(
            [
                block.column("id"),
                block.column("train"),
                pa.array(np.diff(at)),
                pa.array(np.add.reduceat((known > 0).astype(np.int64), begin)),
                pa.array(np.full(len(begin), total)),
                pa.array(np.add.reduceat(base, begin)),
                pa.array(model.score(tokens, at)),
            ],
            names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle once the driver no longer refers to it, which it notices only when it collects
    garbage.  The questions are the largest part of the disk that is used, and are done with before the walk begins."""
    gc.collect()
    spark._jvm.System.gc()


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", kappa: tuple[float, ...] = KAPPA) -> DataFrame:
    """``id_col, train, n_tokens, n_known, train_tokens, base_score, score`` for every row of docs.

    ``train`` says which texts the model learns from (null: not); its order is one more than there are weights in
    ``kappa``.  A null or empty text is its end alone.  Rows are scored one by one, so repeated rows and ids are no
    matter.  An empty table gives no rows; without any training text every token is unknown and the model has one state.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    order = len(kappa) + 1
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    shelf = Shelf(spark, "lm")
    blocks = shelf.put(rows.mapInArrow(frugal(_pack_blocks), "block long, bytes long, rows binary"))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    shards = max(ceil(size / SHARD_BYTES), SHARDS)
    bits = min(64, size.bit_length() + SPARE)
    asked = blocks.select("block", "rows").mapInArrow(frugal(_ask(order, shards, bits)), "block long, n int, shard int, keys binary, counts binary")
    answers = shelf.put(asked.groupBy("shard").applyInArrow(_answer, "block long, n int, shard int, counts binary, tokens long, distinct long"))
    total, vocabulary = answers.where("block = -1").agg(F.sum("tokens"), F.sum("distinct")).first()
    _drop_shuffles(spark)
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    walk = _walk(order, shards, kappa, total or 0, vocabulary or 0, bits)
    walked = blocks.groupBy("block").cogroup(answers.where("block >= 0").select("block", "shard", "counts").groupBy("block")).applyInArrow(walk, schema)
    return walked.withColumnRenamed("id", id_col)
