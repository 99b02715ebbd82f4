"""Cohesion of a word: how tightly its two parts stick together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions.measures import split_strength
from wordmine.operators.ngrams import unigrams


def parts(words: DataFrame) -> DataFrame:
    """Both parts of every split of every word: ``(..., k, side, part)``."""
    splits = words.where(F.length("word") > 1).select(
        "*", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")
    )

    def half(side: str, part: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), part.alias("part"))

    both = F.array(
        half("left", F.substring("word", F.lit(1), F.col("k"))),
        half("right", F.substring("word", F.col("k") + 1, F.length("word"))),
    )
    return splits.select("*", F.inline(both))


def lookup_unigram(parts: DataFrame, grams: DataFrame, part: str) -> DataFrame:
    """Add ``part_freq`` to parts of one character."""
    # A very common character is part of very many words.  The table of single
    # characters is no larger than the alphabet, so it is broadcast and those
    # words stay where they are.
    known = unigrams(grams).select(
        F.col("word").alias(part), F.col("freq").alias("part_freq")
    )
    return parts.join(F.broadcast(known), part)


def lookup_freq(parts: DataFrame, grams: DataFrame, part: str = "part") -> DataFrame:
    """Add ``part_freq``, the dictionary frequency of ``part``.

    Longer parts join with the dictionary by value; Spark broadcasts it when it
    measures it as small, otherwise both sides are shuffled and an overfull
    partition is split at run time.
    """
    longer = grams.where(F.length("word") > 1).select(
        F.col("word").alias(part), F.col("freq").alias("part_freq")
    )
    single = lookup_unigram(parts.where(F.length(part) == 1), grams, part)
    return single.unionByName(
        parts.where(F.length(part) > 1).join(longer, part)
    )


def cohesion(
    words: DataFrame,
    grams: DataFrame,
    total: Column,
    max_len: int,
    cap: float | None = None,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``cohesion`` to words of length 2..``max_len``.

    The minimum over all splits of ``freq * total / left / right``; ``cap`` is
    an upper limit.  ``grams`` may leave out entries rarer than the rarest
    word.  ``total`` is a column, for instance a scalar subquery.  ``lookup`` may
    find the frequencies of the parts of words in another way than in ``grams``.
    """
    words = words.where(F.length("word").between(2, max_len))
    scaled = words.withColumn("_scaled", F.col("freq").cast("double") * total)
    if lookup is None:
        found = lookup_freq(parts(scaled), grams)
    else:
        found = lookup(words).withColumn("_scaled", F.col("freq").cast("double") * total)
    k, side, freq = F.col("k"), F.col("side"), F.col("part_freq")
    freqs, strengths = [], []
    for i in range(1, max_len):
        for name in ("left", "right"):
            here = (k == i) & (side == name)
            freqs.append(F.max(F.when(here, freq)).alias(f"_{name}_{i}"))
        strengths.append(
            split_strength(F.col("_scaled"), F.col(f"_left_{i}"), F.col(f"_right_{i}"))
        )
    least = F.array_min(F.array(*strengths))
    if cap is not None:
        least = F.least(least, F.lit(float(cap)))
    # A word is one row, so its other columns need not be grouped by.
    rest = [F.any_value(c).alias(c) for c in scaled.columns if c != "word"]
    return (
        found.groupBy("word")
        .agg(*rest, *freqs)
        .select(*words.columns, least.alias("cohesion"))
    )
