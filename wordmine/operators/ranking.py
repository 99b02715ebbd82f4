"""Words in order of one feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.session import materialize


def rank_by(df: DataFrame, by: str) -> DataFrame:
    """Words by falling ``by``, ties by word; no rank column."""
    return df.orderBy(F.desc(by), "word")


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The first ``k`` words by falling ``by``, ties by word, with their ``rank`` from 1.

    Every task keeps ``k`` rows at most, and only these meet: no row is dealt to
    ranges.  For a ranking of everything see ``number_by``.
    """
    order = [F.desc(by), F.col("word")]
    first = df.orderBy(*order).limit(k)
    return first.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), *df.columns)


def number_by(df: DataFrame, by: str) -> DataFrame:
    """The same with a ``rank`` column, from 1; stores the sorted rows at once.

    Rows are split into ranges of the sort order and sorted inside each, the one
    shuffle.  A row's id holds its range and its number inside it; only the
    sizes of the ranges, one row per partition, are added up in one place.  The
    word in the sort order keeps the ranges even when ``by`` has few values.
    """
    order = [F.desc(by), F.col("word")]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .count()
        .select("_range", F.sum("count").over(before).alias("_offset"))
    )
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    rank = inside + 1 + F.coalesce("_offset", F.lit(0))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn("rank", rank.cast("bigint"))
        .select("rank", *df.columns)
    )
