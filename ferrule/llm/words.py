"""Vectorised words, word hashes and shingles of whole texts.

A block of texts is handled as one byte buffer, as Arrow holds it.  Words are found by a table of separator
bytes; a word's hash is a difference of prefix sums, so its cost does not depend on Python.  Hashes have 64
bits: within a pair of texts, or among 10**8 different words, a collision is not expected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1_500_000
#: What ends a word: blank and the bytes 9 to 13.
SPACES = bytes([32, *range(9, 14)])
#: Also ASCII punctuation and control characters.
PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum())

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, _U), np.empty(0, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_LETTER = _LETTER[_LOWER]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(n, b, _U)))) for b in (_BASE, _INVERSE))
    return _powers


def forget(most: int = 2 * BLOCK_BYTES) -> None:
    """Drops the table that a very long text has made."""
    global _powers
    if len(_powers[0]) > most:
        _powers = (np.empty(0, _U), np.empty(0, _U))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins; a null text is empty."""
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each."""
    if not len(texts):
        return
    _, at = buffer(texts)
    cut, i = 0, 0
    while cut < len(texts):
        i = max(cut + 1, int(np.searchsorted(at, at[cut] + most, "right")) - 1)
        yield cut, i
        cut = i


def words(texts: pa.Array, separators: bytes = SPACES, spans: bool = False, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Hashes of all words (A-Z in lower case, if ``lower``), in order, and where each text's words begin; then the
    words' spans."""
    data, at = buffer(texts)
    n = len(data)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return (np.empty(0, _U), np.zeros(len(at), dtype=np.int64), none, none)[: 4 if spans else 2]
    gap = np.zeros(256, dtype=bool)
    gap[list(separators)] = True
    inside = ~gap[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _table(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum((_LOWER_LETTER if lower else _LETTER)[data] * power[:n], out=total[1:])
        h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U))
    return (h, np.searchsorted(s, at), s, e)[: 4 if spans else 2]


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's sets of k-word shingles, sorted within the text, and where each set begins.

    A text with fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    n, sizes = len(h), np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        full = max(0, n - k + 1)
        x = np.zeros(full, dtype=_U)
        for i in range(k):
            x = x * _U(_BASE) + h[i : full + i]
        whole = doc[:full] == doc[k - 1 :] if full else np.zeros(0, dtype=bool)
        x, d = mix(x[whole]), doc[:full][whole]
        short = np.flatnonzero((sizes > 0) & (sizes < k))
        if len(short):
            y = np.zeros(len(short), dtype=_U)
            for i in range(k - 1):
                has = sizes[short] > i
                y[has] = y[has] * _U(_BASE) + h[at[short[has]] + i]
            x, d = np.concatenate((x, mix(y + sizes[short].astype(_U)))), np.concatenate((d, short))
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[new], d[new]
    return x, np.searchsorted(d, np.arange(len(sizes) + 1))
