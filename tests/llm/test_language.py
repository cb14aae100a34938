"""The sum over segmentations against listing them all, and rows with columns of the operator's own names."""

import math

import numpy as np
import public_tokenizers
import pytest

from ferrule.llm import langid


def every_segmentation(word, prob):
    if not word:
        return 1.0
    out = 0.0
    for n in range(1, len(word) + 1):
        q = prob.get(word[:n], langid.LOST if n == 1 else 0.0)
        out += q * every_segmentation(word[n:], prob) if q else 0.0
    return out


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(["a", "b", "ab", "aba", "ba", "bb", "\u2581", "\u2581a", "abababababababababab", "\u00e9"])


def test_sums_are_those_of_all_segmentations(pieces):
    rng = np.random.default_rng(4)
    p = np.append(rng.dirichlet(np.ones(len(pieces.pieces))), langid.LOST)
    prob = dict(zip(pieces.pieces, p, strict=False))
    words = ["\u2581" + "".join(rng.choice(list("abz\u00e9"), n, p=[0.5, 0.4, 0.05, 0.05])) for n in range(1, 12) for _ in range(8)]
    got = pieces.word_scores(words, p[:, None])[:, 0]
    assert got == pytest.approx([math.log(every_segmentation(w, prob)) for w in words], rel=1e-9)
    assert pieces.word_scores(["ab" * 10], p[:, None])[0, 0] > math.log(prob["abababababababababab"])  # the longest piece counts


def test_long_runs_are_summed_in_logarithms(pieces):
    p = np.append(np.full(len(pieces.pieces), 0.01), langid.LOST)[:, None]
    whole = "ab" * 14
    lattice = pieces.lattice([whole])
    assert pieces.log_forward(lattice, np.log(p))[lattice[4]] == pytest.approx(np.log(pieces.forward(lattice, p)[lattice[4]]))
    assert np.isfinite(pieces.word_scores(["abz" * 4000], p)).all()


def test_columns_of_the_same_names_are_replaced(spark):
    rows = [("the house is green", "en", "x", 7.0), ("das Haus ist gruen", "de", "y", 8.0), (None, None, "z", None)] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, lang_pred string, score double")
    out = langid.predict(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert sorted(out.columns) == ["lang", "lang_pred", "score", "text"]
    assert {(r.lang, r.lang_pred) for r in out.collect()} == {("en", "en"), ("de", "de"), (None, "und")}
    as_text = langid.predict(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model")), label_as="text")
    assert {(r.lang, r.text) for r in as_text.collect()} == {("en", "en"), ("de", "de"), (None, "und")}
