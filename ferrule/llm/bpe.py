"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The documents of a task are cut into blocks of bounded size.  A block's distinct pretokens form one
small corpus: their bytes lie in one flat symbol array, an inverted index leads from each merge rank to
the positions at which that pair stands, and the merges are replayed over the whole array in rank order.
A merge changes its own position and looks again only at the pair to its left and the pair to its right.
A pair that appears with a rank below the one being replayed is done first, so every word ends as the
lowest-rank-first, leftmost-first rule would leave it.

Blocks need nothing from one another: no shuffle, no driver state, and a lost task is simply run again.

Defined results: a null text is an empty text and has no ids; a null id stays null; repeated rows give
repeated rows; other columns are ignored, so clashing names cannot arise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from .shelf import CACHES, bounded_batches, frugal

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: Words that a worker process keeps from task to task; beyond that only those of the present block stay.
CACHE_ENTRIES = 300_000


class MergeReplay:
    """Encodes pretokens by replaying the ranks over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)
        #: Every way to put two pieces together into a third, and its rank.
        self.pairs = {ranks[w[:i]] << 32 | ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as 32-bit numbers; a word that is itself in the vocabulary is one id."""
        out = [b""] * len(words)
        work: list[int] = []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif w:
                work.append(i)
        if not work:
            return out
        flat = np.frombuffer(b"".join(words[i] for i in work), dtype=np.uint8)
        ends = np.cumsum([len(words[i]) for i in work])
        n = len(flat)
        rk0 = np.full(n, -1, dtype=np.int64)
        rk0[:-1] = self.first[flat[:-1], flat[1:]]
        rk0[ends - 1] = -1
        # The inverted index: rank -> positions in order.  It starts from one stable sort.
        order = np.argsort(rk0, kind="stable")
        order = order[np.searchsorted(rk0[order], 0) :]
        kinds, at = np.unique(rk0[order], return_index=True)
        index: dict[int, list[int]] = {int(k): p.tolist() for k, p in zip(kinds, np.split(order, at[1:]), strict=True)} if len(order) else {}
        heap = sorted(index)
        tok: list[int] = self.single[flat].tolist()
        rk: list[int] = rk0.tolist()
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        for s, e in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            prv[s] = -1
            nxt[e - 1] = -1
        pairs = self.pairs.get
        while heap:
            rank = heappop(heap)
            spots = index.pop(rank, None)
            if spots is None:
                continue
            spots.sort()
            for i, p in enumerate(spots):
                if rk[p] != rank:
                    continue  # its pair has gone meanwhile
                low = rank
                m = nxt[p]
                right, left = nxt[m], prv[p]
                tok[p], rk[m] = rank, -2
                nxt[p] = right
                if right >= 0:
                    prv[right] = p
                    rk[p] = r = pairs(rank << 32 | tok[right], -1)
                    if r >= 0:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heappush(heap, r)
                        if r < low:
                            low = r
                else:
                    rk[p] = -1
                if left >= 0:
                    rk[left] = r = pairs(tok[left] << 32 | rank, -1)
                    if r >= 0:
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            heappush(heap, r)
                        if r < low:
                            low = r
                if low < rank:  # a lower rank has come up: it goes first, what is left here waits
                    if rest := spots[i + 1 :]:
                        index[rank] = rest
                        heappush(heap, rank)
                    break
        alive = np.array(rk, dtype=np.int64) != -2
        ids = np.array(tok, dtype="<i4")[alive].tobytes()
        upto = np.concatenate(([0], 4 * np.cumsum(alive)[ends - 1])).tolist()
        for k, i in enumerate(work):
            out[i] = ids[upto[k] : upto[k + 1]]
        return out


@lru_cache(1)
def _replay(ranks_path: str, pattern: str) -> tuple[MergeReplay, dict[str, bytes]]:
    """The ranks and the table of words for all tasks of a worker process."""
    return MergeReplay.from_file(ranks_path), {}


CACHES.append(_replay)


def encoder(ranks_path: str, pattern: str, id_col: str, text_col: str, with_decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        (replay, table), find = _replay(ranks_path, pattern), regex.compile(pattern).findall
        piece = replay.pieces.__getitem__
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(id_col))
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
            for a, b in W.blocks(texts, BLOCK_BYTES):
                split = [find(x) for x in texts.slice(a, b - a).to_pylist()]
                words = set().union(*split)
                if len(table) > CACHE_ENTRIES:
                    stay = {w: table[w] for w in words if w in table}
                    table.clear()
                    table.update(stay)
                new = list(words.difference(table))
                table.update(zip(new, replay.encode_words([w.encode() for w in new]), strict=True))
                ids = [b"".join(map(table.__getitem__, words)) for words in split]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                columns = [keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if with_decoded:
                    columns.append(pa.array([b"".join(map(piece, flat[s:e].tolist())) for s, e in zip(ends, ends[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """The ids of every text, as ``id_col, ids array<int>``; with_decoded adds the bytes decoded from these ids.

    ``ranks_path`` is a file of base64 pieces and ranks, there on every machine; ``pattern`` cuts a text into
    the pretokens that are merged separately.  No special tokens are made.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * with_decoded
    return docs.select(id_col, text_col).mapInArrow(frugal(encoder(ranks_path, pattern, id_col, text_col, with_decoded), _replay), schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of every row of ids, as ``id_col, decoded binary``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = MergeReplay.from_file(ranks_path).pieces.__getitem__
        for batch in batches:
            out = [b"".join(map(piece, x.as_py() or ())) for x in batch.column(batch.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
