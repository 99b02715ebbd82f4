"""Association measures between the characters of a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions import measures as ms
from wordmine.functions import text as tx
from wordmine.operators.cohesion import lookup_unigram


def character_sums(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Add sum and product of the frequencies of a word's characters."""
    chars = words.select("*", F.explode(tx.characters("word")).alias("part"))
    freq = F.col("part_freq").cast("double")
    rest = [F.any_value(c).alias(c) for c in words.columns if c != "word"]
    return (
        lookup_unigram(chars, grams, "part")
        .groupBy("word")
        .agg(*rest, F.sum(freq).alias("char_sum"), F.product(freq).alias("char_product"))
    )


def association(words: DataFrame, grams: DataFrame, total: Column) -> DataFrame:
    """Add ``ksi, dice, mi, scp, zscore, tscore``."""
    n, f, t = F.length("word"), F.col("freq"), total.cast("double")
    s, p, e = F.col("char_sum"), F.col("char_product"), F.col("ksi")
    return (
        character_sums(words, grams)
        .withColumn("ksi", ms.ksi(p, t, n))
        .select(
            *words.columns,
            "ksi",
            ms.dice(f, s, n).alias("dice"),
            ms.mutual_information(f, p, t, n).alias("mi"),
            ms.scp(f, p, n).alias("scp"),
            ms.zscore(f, e, t).alias("zscore"),
            ms.tscore(f, e, t).alias("tscore"),
        )
    )
