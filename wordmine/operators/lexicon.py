"""Known words in the corpus and the limits learnt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_words(features: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates that the lexicon holds."""
    return features.join(lexicon.select("word"), "word", "left_semi")


def new_words(features: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates that the lexicon does not hold."""
    return features.join(lexicon.select("word"), "word", "left_anti")


def lexicon_envelope(features: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row with the smallest and largest freedom and cohesion of known words."""
    return known_words(features, lexicon).agg(
        F.min("freedom").alias("freedom_low"),
        F.max("freedom").alias("freedom_high"),
        F.min("cohesion").alias("cohesion_low"),
        F.max("cohesion").alias("cohesion_high"),
    )
