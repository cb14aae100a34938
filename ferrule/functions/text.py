"""Text expressions: normalising, tokens, counts, keys.  All are built-in expressions; only stemming needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemmer import stem

NBSP = " "
# Russian function words that say nothing about what is searched.
STOP_WORDS = (
    "в во на по для с со из из-за к ко у о об от до за под над при без и или а но не ни что как это то же ли бы мне меня нужно нужен нужна надо".split()
)


def normalize(text: Column) -> Column:
    """Lower case, yo as ye, no-break spaces as blanks; null becomes empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё" + NBSP, "е ")


def tokens(text: Column) -> Column:
    """All runs of Latin or Russian letters and digits."""
    return F.regexp_extract_all(normalize(text), F.lit("[a-zа-я0-9]+"), F.lit(0))


def without_stop_words(words: Column, stop: list[str] | None = None) -> Column:
    return F.filter(words, lambda w: ~w.isin(list(STOP_WORDS if stop is None else stop)))


def strip(text: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def key(text: Column) -> Column:
    """Lower case without white space at the ends, to find equal titles."""
    return strip(F.lower(text))


def content_hash(text: Column, least: int = 50) -> Column:
    """md5 of the normalized text; null where that is shorter than ``least``."""
    n = strip(normalize(text))
    return F.when(F.length(n) >= least, F.md5(n))


def session_id(*columns: Column) -> Column:
    """16 hexadecimal digits that are equal where all columns are, as text, equal; nulls count as a value."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in columns]
    return F.substring(F.md5(F.concat_ws("\u001f", *parts)), 1, 16)


def split_words(text: Column) -> Column:
    """The blank-separated words of a text that is stored so; none for an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " +"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of the distinct words, in order, each within blanks."""
    w = F.array_distinct(words)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(F.lit(" "), a, F.lit(" "), b, F.lit(" ")))
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(pairs)


def has_any(words: Column, of: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in of])) if of else F.lit(False)


def stems(df: DataFrame, key: str, words: str, into: str) -> DataFrame:
    """df with the array column ``into``: the stem of each word of the array column ``words``, in order.

    Python sees each distinct word once; the stems come back by joins over ``key``, which names a row.
    """

    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem)

    words_of = df.select(key, F.posexplode(words).alias("__i", "__w"))
    vocabulary = words_of.select("__w").distinct().withColumn("__s", stemmed("__w"))
    back = words_of.join(vocabulary, "__w").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", "__s"))).alias("__a"))
    empty = F.array().cast("array<string>")
    return df.join(back, key, "left").withColumn(into, F.coalesce(F.transform("__a", lambda x: x["__s"]), empty)).drop("__a")
