"""Which n-grams are candidate words.

All filters take and return ``(word, freq, ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_length_freq(
    df: DataFrame, max_len: int, min_freq: int, strict: bool = False
) -> DataFrame:
    """Length 2..max_len and frequency >= min_freq (> with ``strict``)."""
    freq = F.col("freq")
    frequent = freq > min_freq if strict else freq >= min_freq
    return df.where(F.length("word").between(2, max_len) & frequent)


def drop_edge_marks(df: DataFrame, marks: str = ".-*") -> DataFrame:
    """Drop words that start or end with one of ``marks``."""
    word, keep = F.col("word"), F.lit(True)
    for mark in marks:
        keep = keep & ~word.startswith(mark) & ~word.endswith(mark)
    return df.where(keep)


def drop_all_digits(df: DataFrame) -> DataFrame:
    """Drop words made of ASCII digits only."""
    return df.where(~F.col("word").rlike("^[0-9]+$"))


def positive_freedom(df: DataFrame) -> DataFrame:
    """Keep words with at least two different neighbours on each side."""
    return df.where(F.col("freedom") > 0)


def drop_stopwords(df: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drop the words of a list.

    The list is broadcast when Spark measures it as small enough; no size is
    assumed here.
    """
    return df.join(stopwords.select("word"), "word", "left_anti")


def candidates_v1(
    grams: DataFrame, stopwords: DataFrame, max_len: int, min_freq: int
) -> DataFrame:
    """More frequent than ``min_freq`` and no stopword."""
    return drop_stopwords(by_length_freq(grams, max_len, min_freq, True), stopwords)


def candidates_v2(
    grams: DataFrame, stopwords: DataFrame, max_len: int, min_freq: int
) -> DataFrame:
    """At least ``min_freq``, no marks at the edges, not a number, no stopword."""
    frequent = by_length_freq(grams, max_len, min_freq)
    return drop_stopwords(drop_all_digits(drop_edge_marks(frequent)), stopwords)


def candidates_v3(
    grams: DataFrame, stopwords: DataFrame, max_len: int, min_freq: int
) -> DataFrame:
    """At least ``min_freq`` and no stopword."""
    return drop_stopwords(by_length_freq(grams, max_len, min_freq), stopwords)


def candidates_v31(
    grams: DataFrame, stopwords: DataFrame, max_len: int, min_freq: int
) -> DataFrame:
    """More frequent than ``min_freq``; a star may stand at the edge."""
    frequent = by_length_freq(grams, max_len, min_freq, True)
    return drop_stopwords(drop_all_digits(drop_edge_marks(frequent, ".-")), stopwords)
