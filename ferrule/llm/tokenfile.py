"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

Documents are ordered by key over all shards (range partitions, sorted within) and encoded; each task cuts its part
into shards of about SHARD_IDS ids.  A shard is one file:

    magic, then 64-bit numbers: id width, documents, ids, hash levels, task, place within the task
    keys (int64), null keys (uint8), ends in ids (uint64) of the documents in order
    sizes of the hash levels (uint64), their bits, and for each slot a fingerprint and an ordinal (uint32 both)
    the ids, as little-endian numbers of 2 bytes if the vocabulary allows it, else of 4

The index is a cascade of bit arrays: a key is placed at the first level where no other key of that level's rest
falls on its bit, and its slot is the number of bits before it.  The slot's fingerprint tells keys that were never
stored, and its ordinal leads to the offset, so a lookup takes constant time whatever the size of the shard.

Files are written by Spark's text writer, one row (of bytes) a file, and read by its binary reader, so they can be
in any store that Spark reaches; a lost task writes its files again under the committer's protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shelf import CACHES, bounded_batches, frugal

MAGIC = b"FRLIDS01"
SHARD_IDS = 4_000_000
BLOCK_BYTES = 2_000_000
#: Words that a worker process keeps from task to task; beyond that only those that came again stay, if few enough.
CACHE_ENTRIES = 2_000_000
#: What no token goes over.
SEPARATORS = b" \n"
_U = np.uint64


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(keys.astype(np.int64).view(_U) * _U(W._BASE) + W.mix(np.array([seed + 1], dtype=_U)))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one bit array (as bool) a level
        self.before = np.concatenate(([0], np.cumsum([int(b.sum()) for b in levels]))).astype(np.int64)
        self.rank = [np.concatenate(([0], np.cumsum(b))) for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(2 * len(rest), 8)
            at = (_hash(rest, len(levels)) % _U(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            rest = rest[hits[at] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key finds no bit, which no stored key does."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (_hash(keys[todo], i) % _U(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.before[i] + self.rank[i][at[hit]]
            todo = todo[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xF19) >> _U(32)).astype("<u4")


class Shard:
    """A shard in memory: ``find(key)`` gives its ids in constant time."""

    def __init__(self, keys, nulls, ends, index: PerfectHash, prints, ordinals, ids, task: int, place: int):
        self.keys, self.nulls, self.ends, self.index, self.prints, self.ordinals, self.ids = keys, nulls, ends, index, prints, ordinals, ids
        self.task, self.place = task, place

    @classmethod
    def build(cls, keys: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray, task: int, place: int) -> Shard:
        """Of documents in order of their keys; a key that is there repeatedly leads to its first document."""
        some = np.flatnonzero(~nulls)
        distinct, first = np.unique(keys[some], return_index=True)
        index = PerfectHash.build(distinct)
        slot = index.slots(distinct)
        prints, ordinals = np.empty(len(distinct), "<u4"), np.empty(len(distinct), "<u4")
        prints[slot], ordinals[slot] = fingerprint(distinct), some[first]
        return cls(keys, nulls, ends, index, prints, ordinals, ids, task, place)

    def write(self) -> bytes:
        head = struct.pack("<6q", self.ids.itemsize, len(self.keys), len(self.ids), len(self.index.levels), self.task, self.place)
        levels = [np.array([len(b) for b in self.index.levels], dtype="<u8").tobytes(), *[np.packbits(b).tobytes() for b in self.index.levels]]
        return b"".join((MAGIC, head, self.keys.astype("<i8").tobytes(), self.nulls.astype(np.uint8).tobytes(), self.ends.astype("<u8").tobytes(), *levels, self.prints.tobytes(), self.ordinals.tobytes(), self.ids.tobytes()))

    @classmethod
    def read(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        width, n, n_ids, n_levels, task, place = struct.unpack_from("<6q", data, 8)
        at = 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        keys, nulls, ends = take("<i8", n), take("u1", n).astype(bool), take("<u8", n).astype(np.int64)
        sizes = take("<u8", n_levels).tolist()
        index = PerfectHash([np.unpackbits(take("u1", -(-s // 8)), count=s).astype(bool) for s in sizes])
        m = int(index.before[-1])
        return cls(keys, nulls, ends, index, take("<u4", m), take("<u4", m), take(f"<u{width}", n_ids), task, place)

    def document(self, ordinal: int) -> np.ndarray:
        return self.ids[self.ends[ordinal - 1] if ordinal else 0 : self.ends[ordinal]]

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """The ordinal of each key's first document, by hash and fingerprint; -1 for keys that are not stored."""
        slot = self.index.slots(keys)
        hit = slot >= 0
        hit[hit] = self.prints[slot[hit]] == fingerprint(keys[hit])
        out = np.full(len(keys), -1, dtype=np.int64)
        out[hit] = self.ordinals[slot[hit]]
        out[hit] = np.where(self.keys[out[hit]] == keys[hit], out[hit], -1)
        return out

    def find(self, key: int) -> np.ndarray | None:
        ordinal = int(self.locate(np.array([key], dtype=np.int64))[0])
        return None if ordinal < 0 else self.document(ordinal)

    def located(self) -> np.ndarray:
        """The ordinals of all documents: of each key's first by the index, of null and repeated keys those behind it."""
        out = np.arange(len(self.keys))
        some = np.flatnonzero(~self.nulls)
        first = np.concatenate(([True], self.keys[some][1:] != self.keys[some][:-1])) if len(some) else np.zeros(0, bool)
        out[some[first]] = self.locate(self.keys[some[first]])
        if (out < 0).any():
            raise ValueError("a document is not found by its key: the shard is damaged")
        return out


class WordEncoder:
    """Ids of whole texts, word by word: no merge of this kind of tokenizer goes over a blank or a line's end.

    Words are told apart by 64-bit hashes.  Each is encoded once and its ids are kept, so a text costs a lookup for
    each of a block's distinct words.  Words of letters alone are encoded many at a time and told apart by the mark
    that their last piece carries.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Known words: sorted hashes, each one's number, and by number the ends of its ids in ``data``."""
        self.hash, self.number = np.empty(0, _U), np.empty(0, np.int64)
        self.ends, self.data = np.zeros(1, np.int64), np.empty(0, self.kind)
        self.again = np.empty(0, bool)

    def _shrink(self) -> None:
        """Only words that came in several blocks stay; none, if those are half of all."""
        stay = self.again[self.number]
        if 2 * stay.sum() > CACHE_ENTRIES:
            return self.forget()
        n = self.number[stay]
        size = self.ends[n + 1] - self.ends[n]
        ends = np.cumsum(size)
        self.data = self.data[np.repeat(self.ends[n] - ends + size, size) + np.arange(size.sum())]
        self.hash, self.number, self.ends = self.hash[stay], np.arange(len(n)), np.concatenate(([0], ends)).astype(np.int64)
        self.again = np.zeros(len(n), bool)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters alone."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            (ids,) = self._ids([" ".join(part)])
            ends = np.flatnonzero(self.last[ids]) + 1
            fits = len(ends) == len(part) and ends[-1] == len(ids)
            out += np.split(ids, ends[:-1]) if fits else self._ids(part)
        return out

    def _keep(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        if len(ids):
            new = len(self.ends) - 1 + np.arange(len(ids))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])))
            self.data = np.concatenate((self.data, *ids))
            self.again = np.concatenate((self.again, np.zeros(len(ids), bool)))
            by = np.argsort(hashes)
            at = np.searchsorted(self.hash, hashes[by])
            self.hash, self.number = np.insert(self.hash, at, hashes[by]), np.insert(self.number, at, new[by])

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that is not known."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.number[at], -1)

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Of words that are not known."""
        letters = np.array([w.isalpha() for w in words], dtype=bool)
        # a mark that ends a word of letters, also after the tokenizer's own normalising, is a pretoken of its own
        tail = [i for i, w in enumerate(words) if w[-1] in ",.!?;:" and (w[:-1] if w.isascii() else normalize("NFC", w[:-1]).lower()).isalpha()]
        base = [words[i][:-1] for i in tail]
        base_hash = W.words(pa.array(base, pa.string()), SEPARATORS, lower=False)[0]
        plain = np.flatnonzero(letters)
        _, first = np.unique(base_hash, return_index=True)
        more = first[(self._found(base_hash[first]) < 0) & ~np.isin(base_hash[first], hashes[plain])]
        self._keep(np.concatenate((hashes[plain], base_hash[more])), self._letters([words[i] for i in plain] + [base[i] for i in more]))
        if tail:
            marks = sorted({words[i][-1] for i in tail})
            marks = dict(zip(marks, self._ids(marks), strict=True))
            n = self._found(base_hash)
            self._keep(hashes[tail], [np.concatenate((self.data[self.ends[j] : self.ends[j + 1]], marks[words[i][-1]])) for i, j in zip(tail, n.tolist(), strict=True)])
        rest = ~letters
        rest[tail] = False
        rest = np.flatnonzero(rest)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            self._keep(hashes[part], self._ids([words[j] for j in part]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        h, at, s, e = W.words(texts, SEPARATORS, spans=True, lower=False)
        if not len(h):
            return np.empty(0, self.kind), np.zeros(len(texts), np.int64)
        u, some, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_ENTRIES:
            self._shrink()
        n = self._found(u)
        self.again[n[n >= 0]] = True
        new = np.flatnonzero(n < 0)
        if len(new):
            raw = W.buffer(texts)[0].tobytes()
            self.learn([raw[x:y].decode() for x, y in zip(s[some[new]].tolist(), e[some[new]].tolist(), strict=True)], u[new])
        n = self._found(u)[place]
        size = self.ends[n + 1] - self.ends[n]
        ends = np.cumsum(size)
        ids = self.data[np.repeat(self.ends[n] - ends + size, size) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[at[1:]]


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)


CACHES.append(_encoder)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the shards into the folder ``path``.

    Keys are integers.  Null keys come first and can be read in order, but not looked up; equal keys are in order of
    their texts.  A null text is empty; ``end_id`` is put after each document.  An empty table writes no shard.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, place = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, nulls, ends, data = [], [], [], []

        def shard() -> pa.RecordBatch:
            at, ids = np.cumsum([0] + [len(x) for x in data[:-1]]), np.concatenate(data)
            all_ends = np.concatenate([x + y for x, y in zip(ends, at, strict=True)])
            out = Shard.build(np.concatenate(keys), np.concatenate(nulls), all_ends, ids, task, place)
            return pa.RecordBatch.from_arrays([pa.array([out.write()], pa.binary())], names=["value"])

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in W.blocks(texts, BLOCK_BYTES):
                k = batch.column(0).slice(a, b - a)
                ids, upto = encoder.encode(texts.slice(a, b - a))
                if end_id is not None:
                    ids = np.insert(ids, upto, end_id)
                    upto = upto + np.arange(1, len(upto) + 1)
                data.append(ids)
                ends.append(upto)
                nulls.append(pc.is_null(k).to_numpy(zero_copy_only=False))
                keys.append(pc.fill_null(k, 0).to_numpy(zero_copy_only=False))
                if sum(map(len, data)) >= SHARD_IDS:
                    yield shard()
                    keys, nulls, ends, data, place = [], [], [], [], place + 1
        if keys:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "text")
    shards = rows.mapInArrow(frugal(run, _encoder), "value binary").select(F.col("value").cast("string"))
    shards.write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``key, task, place, ordinal, start_in_shard, n_tokens, ids_crc32`` of every document in the folder's shards.

    Each key's offset comes from the shard's perfect hash; null keys and the repetitions of a key have no slot of
    their own and follow in order.  A key that its own shard does not find raises an error.  The checksum is that of
    the ids as little-endian unsigned 32-bit numbers.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                s = Shard.read(x.as_py())
                n, at = len(s.keys), s.located()
                starts = np.concatenate(([0], s.ends[:-1])).astype(np.int64)[at]
                ends = s.ends[at]
                ids = memoryview(s.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(s.keys, mask=s.nulls), pa.array(np.full(n, s.task)), pa.array(np.full(n, s.place)), pa.array(at), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "task", "place", "ordinal", "start_in_shard", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(frugal(run, _encoder), "key long, task long, place long, ordinal long, start_in_shard long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``key_col, ids`` of the stored documents among ``keys``, by the shards' perfect hash.

    Keys are sent to the shards whose range may hold them; within a shard a key takes constant time.  Keys that are
    null or not stored give no row.
    """
    bounded_batches(spark)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, x in zip(batch.column(0), batch.column(1), strict=True):
                s = Shard.read(x.as_py())
                if not s.nulls.all():
                    k = s.keys[~s.nulls]
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([int(k[0])]), pa.array([int(k[-1])])], names=["path", "lo", "hi"])

    def find(key: tuple, wanted: pa.Table, files: pa.Table) -> pa.Table:
        out = []
        for x in files.column("content"):
            s = Shard.read(x.as_py())
            out += [(k, ids.tolist()) for k in sorted(set(wanted.column("k").to_pylist())) if (ids := s.find(k)) is not None]
        return pa.table([pa.array([k for k, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int64()))], names=["k", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    where = files.mapInArrow(ranges, "path string, lo long, hi long")
    wanted = keys.select(F.col(key_col).cast("long").alias("k")).where("k is not null").distinct()
    routed = wanted.join(where, (F.col("k") >= F.col("lo")) & (F.col("k") <= F.col("hi"))).select("path", "k")
    found = routed.groupBy("path").cogroup(files.groupBy("path")).applyInArrow(find, "k long, ids array<long>")
    return found.withColumnRenamed("k", key_col)


def layout(rows: DataFrame) -> DataFrame:
    """Rows of ``read`` with ``start``: the number of ids in all documents before."""
    shards = rows.groupBy("task", "place").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task", "place").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("task", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(shards, ["task", "place"]).withColumn("start", F.col("before") + F.col("start_in_shard"))
