"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits in lower case; characters of scripts without blanks between words (Han,
Hiragana, Katakana, Thai) are tokens of their own.  Each of the fixed MASKS is laid over every run of tokens of
its length; the tokens under its zeros are ignored, so a substitution there does no harm.  Equal hashes of a
benchmark item and of a text are a hit, and fix how far the text is shifted against the item.  Around each shift
the item is compared with the text, token by token without gaps: it overlaps where

* MIN_MATCH tokens or more are equal and they are at least COVER of the item's tokens, or
* a stretch has at least LONG equal tokens net of four for each substitution in it.

An item with fewer tokens than the longest mask is also looked for by its whole sequence, from SHORTEST tokens on;
items below that are too short to be a passage and are ignored.

The benchmark is the query set and all texts are searched.  Its index is broadcast in slices of SLICE_BYTES of
text, so what is broadcast has a bound at any size of the benchmark; texts are read once for each slice.

The masks find all overlaps of a 40-token item with up to 10 % of its tokens replaced at random, and more than nine in
ten up to 30 % (tests/llm/test_seeds.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from .shelf import Shelf, bounded_batches, frugal

MASKS = ("11101011", "110110010011", "1100101000110001", "101001110100001001")
MIN_MATCH = 8
COVER = 0.5
LONG = 24
SHORTEST = 5
#: The index of a slice takes about 31 times its text, in each Python worker.
SLICE_BYTES = 2 << 20
_U = np.uint64


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    lead = W.buffer(texts)[0]
    if ((lead == 0xC2) | (lead >= 0xE0)).any():  # what begins so may be punctuation, a blank or a sign of such scripts
        texts = pc.replace_substring_regex(texts, r"[\p{P}\p{S}\p{Z}]", " ")
        texts = pc.replace_substring_regex(texts, r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])", r" \1 ")
    return W.words(texts, W.PUNCTUATION)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at each place where the mask fits, ends of texts not regarded."""
    n = max(0, len(h) - len(mask) + 1)
    x = np.full(n, _U(sum(int(c) << i for i, c in enumerate(mask))) + _U(len(mask) << 32))
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                x = x * _U(W._BASE) + h[i : i + n]
    return W.mix(x)


class Index:
    """Seeds of a slice of the benchmark: hash -> (item, place)."""

    def __init__(self, item_ids: list, texts: pa.Array):
        self.ids = item_ids
        self.tokens, self.at = tokens(texts)
        sizes = np.diff(self.at)
        longest = max(map(len, MASKS))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.short = sorted({int(n) for n in sizes if SHORTEST <= n < longest})
        rows = []
        for mask in (*MASKS, *("1" * n for n in self.short)):
            x = seeds(self.tokens, mask)
            i = np.arange(len(x))
            ok = owner[: len(x)] == owner[len(mask) - 1 :]
            if "0" not in mask:
                ok &= sizes[owner[: len(x)]] == len(mask)  # whole items of this length only
            rows.append((x[ok], i[ok]))
        self.hash, place = (np.concatenate(y) for y in zip(*rows, strict=True))
        by = np.argsort(self.hash, kind="stable")
        self.hash, place = self.hash[by], place[by]
        self.item, self.place = owner[place], place - self.at[owner[place]]
        bits = max(16, int(np.ceil(np.log2(len(self.hash) + 1))) + 5)
        self.shift = _U(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True

    def shifts(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place in the text where the item would begin) of all hits."""
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found = [np.empty((0, 3), dtype=np.int64)]
        for mask in (*MASKS, *("1" * n for n in self.short)):
            x = seeds(h, mask)
            p = np.flatnonzero(self.seen[(x >> self.shift).astype(np.int64)])
            lo = np.searchsorted(self.hash, x[p])
            n = np.searchsorted(self.hash, x[p], "right") - lo
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            inside = doc[p] == doc[p + len(mask) - 1]
            p, lo, n = p[inside], lo[inside], n[inside]
            # a seed can stand at many places of the benchmark: they are taken a bounded number at a time
            for s, e in _runs(n):
                hit = np.repeat(lo[s:e], n[s:e]) + np.arange(n[s:e].sum()) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e])
                d = np.repeat(p[s:e], n[s:e])
                rows = np.stack((doc[d], self.item[hit], d - at[doc[d]] - self.place[hit]), axis=1)
                found.append(np.unique(rows, axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, begin, equal tokens) of the best overlap of each text with each item that overlaps."""
        h, at = tokens(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, begin in self.shifts(h, at).tolist():
            doc, item = h[at[d] : at[d + 1]], self.tokens[self.at[i] : self.at[i + 1]]
            lo, hi = max(0, -begin), min(len(item), len(doc) - begin)
            same = doc[begin + lo : begin + hi] == item[lo:hi]
            n = int(same.sum())
            if not (n >= min(MIN_MATCH, len(item)) and n >= COVER * len(item)):
                if len(item) < LONG or n < LONG:
                    continue
                net = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
                if (net - np.minimum.accumulate(net)).max() < LONG:
                    continue
            if (-n, begin) < (-best[d, i][1], best[d, i][0]) if (d, i) in best else True:
                best[d, i] = (begin, n)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def _runs(n: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    ends, s = np.cumsum(n), 0
    while s < len(n):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's items in slices of bounded size; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(id_col, text_col).where(f"`{text_col}` is not null").distinct().toLocalIterator():
        ids.append(row[0]), texts.append(row[1])
        size += len(row[1])
        if size >= SLICE_BYTES:
            yield Index(ids, pa.array(texts, pa.string()))
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, pa.array(texts, pa.string()))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, item_col, begin, n_equal, n_item, cover`` for every pair of a text and a benchmark item that overlap.

    begin is the token of the text (from 0) at which the item would begin, n_equal the number of equal tokens, cover
    their share of the item's n_item tokens; of several overlaps of a pair that with most equal tokens is given, then
    the first.  Null and empty texts and items overlap with nothing; repeated rows of docs give repeated pairs,
    repeated items count once; empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, begin long, n_equal long, n_item long, cover double"
    rows = docs.select(id_col, text_col)

    def search(shared, item_type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            size = np.diff(index.at)
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "")
                for a, b in W.blocks(texts):
                    found = index.overlaps(texts.slice(a, b - a))
                    if found:
                        d, i, begin, n = zip(*found, strict=True)
                        m = [int(size[x]) for x in i]
                        columns = [batch.column(0).slice(a, b - a).take(pa.array(d)), pa.array([index.ids[x] for x in i]).cast(item_type)]
                        columns += [pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array([x / y for x, y in zip(n, m, strict=True)])]
                        yield pa.RecordBatch.from_arrays(columns, names=[id_col, item_col, "begin", "n_equal", "n_item", "cover"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out, shelf = None, Shelf(spark, "decontaminate")
    for index in _slices(benchmark, item_col, item_text_col):
        if out is not None and not hasattr(out, "_shelf_path"):
            out = shelf.put(out)
        part = rows.mapInArrow(frugal(search(spark.sparkContext.broadcast(index), item_type)), schema)
        out = part if out is None else shelf.put(out.unionByName(part))
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps with no benchmark item."""
    bounded_batches(docs.sparkSession)
    spark, text_at = docs.sparkSession, docs.columns.index(text_col)

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pc.fill_null(batch.column(text_at), "")
                ok = np.ones(len(texts), dtype=bool)
                for a, b in W.blocks(texts):
                    for d, *_ in shared.value.overlaps(texts.slice(a, b - a)):
                        ok[a + d] = False
                yield batch.filter(pa.array(ok))

        return run

    for index in _slices(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(frugal(keep(spark.sparkContext.broadcast(index))), docs.schema)
    return docs
