"""Quality rules, and a likelihood ratio of hashed n-grams.

Single words and pairs of neighbours are hashed to ``BUCKETS`` buckets.  Counts
over all documents give one multinomial for the trusted ones and one for the raw
corpus.  A text's mean log ratio of the two, over its n-grams, says how much more
like trusted text it is.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.session import materialize

BUCKETS = 1 << 15
#: Mean log ratio from which a text is kept.
LEAST_RATIO = -0.12
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Trusted ids up to which they are sent to every task (32 MB).
BROADCAST_IDS = 2_000_000

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def with_words(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text, and ``w``: its words hashed to 64 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("t"))
    bare = F.trim("t", F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+")
    )
    return rows.select("doc_id", "t", F.transform(words, lambda x: F.xxhash64(x)).alias("w"))


def _pairs(words: str = "w") -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket, weight``: log ratio of the smoothed shares, counted over all documents.

    ``trusted`` holds the ``doc_id`` of trusted documents.  Without any, or without
    words, every weight is 0.  The counts are stored at once.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = with_words(docs).join(ids, "doc_id", "left")
    rows = rows.select("w", _pairs().alias("p"), F.coalesce("good", F.lit(0)).alias("good"))
    both = rows.select("good", F.explode(F.concat("w", "p")).alias("g"))
    counted = both.groupBy(F.pmod("g", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(
        F.sum("good").alias("good"), F.count("*").alias("raw")
    )
    counted = (
        docs.sparkSession.range(0, BUCKETS, 1, 1)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(F.broadcast(counted), "bucket", "left")
        .fillna(0)
    )
    # Stored, as the totals and the weights both read it.
    counted = materialize(counted)
    totals = counted.agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).first()
    extra = SMOOTHING * BUCKETS
    if not totals["good"]:
        return counted.select("bucket", F.lit(0.0).alias("weight"))
    share = lambda c, n: (F.col(c) + SMOOTHING) / (n + extra)
    ratio = F.log(share("good", totals["good"]) / share("raw", totals["raw"]))
    # Rounded, so that no sum depends on the last bits of a logarithm.
    return counted.select("bucket", F.round(ratio, 9).alias("weight"))


def _dup_lines() -> Column:
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def judged(docs: DataFrame, weights: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Counts, ``base_failed``, ``ratio`` and ``kept`` of every row of ``docs``.

    A null text counts as empty; its ratio is 0 and it fails the rules.
    """
    rows = with_words(docs)
    rows = rows.select("doc_id", "t", "w", _pairs().alias("p"))
    n = F.size("w")
    most = F.greatest(n - 2, F.lit(0))
    windows = F.zip_with(F.slice("p", 1, most), F.slice("w", 3, most), lambda a, b: F.xxhash64(a, b))
    # One row with BUCKETS numbers, read as a constant.
    table = weights.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]
        ).alias("weights")
    ).scalar()
    # BUCKETS is a power of two, so its bits are the remainder.
    weight = lambda a, x: a + F.get(F.col("table"), x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    rows = rows.select("doc_id", "t", "w", "p", windows.alias("v"), table.alias("table"))
    sums = F.aggregate("w", F.lit(0.0), weight) + F.aggregate("p", F.lit(0.0), weight)
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines().cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("v")) == F.size("v"), F.lit(None))
        .otherwise(F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
        .alias("s"),
        F.round(sums / F.greatest(n + F.size("p"), F.lit(1)), 9).alias("ratio"),
    )
    twice = lambda x, i: (
        (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    )
    places = F.array_sort(
        F.transform(F.filter("s", lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"])
    )
    rows = rows.withColumn("at", places)
    gaps = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    failed = (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    rows = rows.withColumn("n_repeat_words", covered.cast("long")).withColumn("base_failed", failed)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("ratio") >= least)).alias("kept"),
        "ratio",
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents rated good and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id")
