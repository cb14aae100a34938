"""Language identification by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary.  Each language has a probability for each piece, fitted by
expectation maximisation; the forward algorithm over a word's lattice of pieces sums the probability of all its
segmentations.  A text's evidence for a language is the sum over all its words.

Words are runs of letters (ASCII letters in lower case, and all characters beyond ASCII), with the vocabulary's
word mark before them.  The sums over a run of more than MOST_CHARS characters are taken in logarithms, as they would
leave the range of doubles; fitting takes such a run in parts of that length.  A character that no piece covers costs
the same in every language.

Fitting reads a bounded sample: for each label the labelled texts with the smallest hashes, whole, up to
SAMPLE_BYTES (at least one).  What is broadcast has the size of the vocabulary times the number of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shelf import bounded_batches, frugal

SAMPLE_BYTES = 2_000_000
BLOCK_BYTES = 4_000_000
MOST_CHARS = 32
ROUNDS = 4
#: Probability of a character that no piece covers.
LOST = 1e-7
MARK = "▁"
_U = np.uint64
LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())


class Pieces:
    """The vocabulary's pieces as sorted hashes of their characters."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p.lower() for p in pieces if p})
        self.longest = max(map(len, self.pieces), default=0)
        chars = np.concatenate([self._chars(p) for p in self.pieces]) if self.pieces else np.empty(0, np.uint32)
        ends = np.cumsum([len(p) for p in self.pieces])
        h = self.spans(self.prefix(chars), ends - [len(p) for p in self.pieces], ends)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hash >> _U(44)).astype(np.int64)] = True

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))])

    @staticmethod
    def _chars(s: str) -> np.ndarray:
        return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)

    @staticmethod
    def prefix(chars: np.ndarray) -> np.ndarray:
        power, _ = W._table(len(chars) + 1)
        with np.errstate(over="ignore"):
            return np.concatenate((np.zeros(1, _U), np.cumsum(W.mix(chars.astype(_U) + _U(1)) * power[: len(chars)])))

    @staticmethod
    def spans(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        _, inverse = W._table(len(prefix))
        with np.errstate(over="ignore"):
            return W.mix((prefix[e] - prefix[s]) * inverse[s])

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Edges (from, to, piece or -1) between characters' places, in steps of equal distance from the word's begin.

        Each word has one place more than it has characters; also given: each word's first and last place, and
        where each step's edges begin.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        first = np.concatenate(([0], np.cumsum(sizes)))
        prefix = self.prefix(chars)
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(chars))
        end = first[1:][word]
        a, b, k = [], [], []
        reached = np.zeros(len(chars) + 1, dtype=bool)
        for n in range(1, max(self.longest, 1) + 1):
            s = at[at + n <= end[at]]
            if not len(s):
                break
            h = self.spans(prefix, s, s + n)
            maybe = np.flatnonzero(self.seen[(h >> _U(44)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
            hit = self.hash[i] == h[maybe]
            s = s[maybe[hit]]
            a.append(s), b.append(s + n), k.append(self.order[i[hit]])
            if n == 1:
                lost = np.ones(len(chars), dtype=bool)
                lost[s] = False
                lost = np.flatnonzero(lost)
                a.append(lost), b.append(lost + 1), k.append(np.full(len(lost), -1))
        a, b, k = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, k))
        w = word[a]
        step = b - first[w]
        by = np.lexsort((b, step))
        a, b, k, w, step = a[by], b[by], k[by], w[by], step[by]
        steps = np.searchsorted(step, np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
        return a + w, b + w, k, first[:-1] + np.arange(len(words)), first[1:] + np.arange(len(words)), steps

    def forward(self, lattice: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
        """For every place, the probability of all ways to it; p has a row for each piece, and LOST as its last."""
        a, b, k, first, last, steps = lattice
        alpha = np.zeros((int(last[-1]) + 1 if len(last) else 0, p.shape[1]))
        alpha[first] = 1.0
        for x, y in zip(steps, steps[1:], strict=False):
            if x == y:
                continue
            to = b[x:y]
            new = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            alpha[to[new]] = np.add.reduceat(alpha[a[x:y]] * p[k[x:y]], new, axis=0)
        return alpha

    def log_forward(self, lattice: tuple[np.ndarray, ...], log_p: np.ndarray) -> np.ndarray:
        """The logarithms of what ``forward`` gives."""
        a, b, k, first, last, steps = lattice
        alpha = np.full((int(last[-1]) + 1 if len(last) else 0, log_p.shape[1]), -np.inf)
        alpha[first] = 0.0
        for x, y in zip(steps, steps[1:], strict=False):
            if x == y:
                continue
            to = b[x:y]
            new = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            alpha[to[new]] = np.logaddexp.reduceat(alpha[a[x:y]] + log_p[k[x:y]], new, axis=0)
        return alpha

    def fit(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Probabilities of the pieces, by expectation maximisation over the words."""
        n = len(self.pieces)
        expected = np.zeros(n)
        parts = [slice(i, i + 20_000) for i in range(0, len(words), 20_000)]
        lattices = [(self.lattice(words[s]), counts[s]) for s in parts]
        for lattice, c in lattices:
            a, _, k, first, *_ = lattice
            ok = k >= 0
            expected += np.bincount(k[ok], weights=c[np.searchsorted(first, a[ok], "right") - 1], minlength=n)
        for _ in range(ROUNDS):
            p = np.append(self._smooth(expected), LOST)[:, None]
            expected = np.zeros(n)
            for lattice, c in lattices:
                a, b, k, first, last, steps = lattice
                alpha = self.forward(lattice, p)[:, 0]
                beta = np.zeros(len(alpha))
                beta[last] = c / np.maximum(alpha[last], 1e-300)
                for x, y in zip(steps[-2::-1], steps[:0:-1], strict=True):
                    np.add.at(beta, a[x:y], beta[b[x:y]] * p[k[x:y], 0])
                flow = alpha[a] * p[k, 0] * beta[b]
                ok = k >= 0
                expected += np.bincount(k[ok], weights=flow[ok], minlength=n)
        return self._smooth(expected)

    @staticmethod
    def _smooth(counts: np.ndarray) -> np.ndarray:
        return (counts + 0.02) / (counts.sum() + 0.02 * len(counts)) if len(counts) else counts

    def word_scores(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log probability of each word in each language."""
        out = np.empty((len(words), p.shape[1]))
        size = np.array([len(w) for w in words])
        short, long = np.flatnonzero(size <= MOST_CHARS), np.flatnonzero(size > MOST_CHARS)
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            lattice = self.lattice([words[j] for j in part])
            out[part] = np.log(np.maximum(self.forward(lattice, p)[lattice[4]], 1e-300))
        if len(long):
            log_p = np.log(p)
            for part in np.split(long, np.flatnonzero(np.diff(np.cumsum(size[long]) // 100_000)) + 1):
                lattice = self.lattice([words[j] for j in part])
                out[part] = self.log_forward(lattice, log_p)[lattice[4]]
        return out


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked words, each position's place among them, and where each text's words begin."""
    h, at, s, e = W.words(texts, LETTERS, spans=True)
    _, some, place = np.unique(h, return_index=True, return_inverse=True)
    data = W.buffer(texts)[0].tobytes()
    return [data[x:y].decode("utf-8", "replace").lower() for x, y in zip(s[some].tolist(), e[some].tolist(), strict=True)], place, at


def _parts(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked words, the long ones in parts, and the word of each part."""
    if max(map(len, words), default=0) <= MOST_CHARS:
        return [MARK + w for w in words], np.arange(len(words))
    out, owner = [], []
    for i, w in enumerate(words):
        for j in range(0, len(w), MOST_CHARS):
            out.append((MARK if j == 0 else "") + w[j : j + MOST_CHARS])
            owner.append(i)
    return out, np.array(owner)


def text_scores(pieces: Pieces, p: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The evidence for each language in each text, and its number of words."""
    words, place, at = distinct_words(texts)
    per_word = pieces.word_scores([MARK + w for w in words], p)
    total = np.zeros((len(texts), p.shape[1]))
    has = np.diff(at) > 0
    if has.any():
        total[has] = np.add.reduceat(per_word[place], at[:-1][has], axis=0)
    return total, np.diff(at)


class Model:
    """Labels in order, the vocabulary's file and the pieces' probabilities in each language."""

    def __init__(self, labels: list[str], path: str, p: np.ndarray):
        self.labels, self.path, self.p = labels, path, p


def fit(labelled: DataFrame, vocabulary: str, text_col: str = "text", label_col: str = "lang") -> Model:
    """Learns from the labelled texts: of each label those with the smallest hashes, whole, up to SAMPLE_BYTES."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null and text <> ''")
    # labels with much text are thinned by hash first, so what is dealt to a label's task has a bound at any size; the
    # sizes, a row a label as in the model itself, are broadcast so that no text is dealt by label before it is thinned
    rows = rows.withColumn("h", F.xxhash64("text", "label"))
    sizes = rows.groupBy("label").agg(F.sum(F.octet_length("text").cast("double")).alias("bytes"), F.min("h").alias("least"))
    rows = rows.join(F.broadcast(sizes), "label").where(((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("bytes") <= 2 * SAMPLE_BYTES) | (F.col("h") == F.col("least")))
    by = Window.partitionBy("label").orderBy("h", "text")
    upto = F.sum(F.octet_length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("i", F.row_number().over(by)).withColumn("upto", upto).where((F.col("upto") <= SAMPLE_BYTES) | (F.col("i") == 1))

    def one(group: pa.Table) -> pa.Table:
        pieces = Pieces.from_file(vocabulary)
        words, place, _ = distinct_words(group.column("text").combine_chunks())
        parts, owner = _parts(words)
        counts = np.bincount(place, minlength=len(words)).astype(float)[owner] if words else np.zeros(0)
        return pa.table({"label": [group.column("label")[0].as_py()], "p": pa.array([pieces.fit(parts, counts).tobytes()], pa.binary())})

    got = rows.select("label", "text").groupBy("label").applyInArrow(one, "label string, p binary").collect()
    got.sort(key=lambda r: r["label"])
    p = np.stack([np.append(np.frombuffer(bytes(r["p"])), LOST) for r in got], axis=1) if got else np.zeros((0, 0))
    return Model([r["label"] for r in got], vocabulary, p)


def predict(docs: DataFrame, model: Model, text_col: str = "text", label_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """All columns of docs, with ``lang_pred string, score double``, in place of columns of these names that docs has.

    lang_pred is the most probable label, the first in order among equals; ``und``, with score 0, where the text is
    null or has no letter, or where nothing could be learned.  score is the label's posterior probability.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.labels, model.path, model.p))
    names = [c for c in docs.columns if c not in (label_as, score_as)]
    text_at = len(names)  # the text again, as it may be a column that is replaced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        labels, path, p = shared.value
        pieces = Pieces.from_file(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(text_at), "")
            for a, b in W.blocks(texts, BLOCK_BYTES):
                part = texts.slice(a, b - a)
                if labels:
                    total, n = text_scores(pieces, p, part)
                    total -= total.max(axis=1, keepdims=True)
                    best = total.argmax(axis=1)
                    score = 1 / np.exp(total).sum(axis=1)
                    plain = pc.match_substring_regex(part, "[A-Za-z]").to_numpy(zero_copy_only=False)
                    none = np.array([not plain[i] and not letter(part[i].as_py()) for i in range(len(part))], dtype=bool)
                    found = ["und" if no else labels[i] for i, no in zip(best, none, strict=True)]
                    score = np.where(none, 0.0, score)
                else:
                    found, score = ["und"] * len(part), np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:text_at], pa.array(found, pa.string()), pa.array(score)], names=[*names, label_as, score_as])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + f", `{label_as}` string, `{score_as}` double"
    return docs.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(frugal(run), schema)

