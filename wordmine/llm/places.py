"""Places of rows in the order of their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.session import materialize


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``pos``, the place within the group from 0, and ``n``, the size of the group.

    Rows are dealt to ranges of the order and numbered inside each; only a row per
    group and range is added up beyond, so a group may be of any size.  Values of
    ``group`` must not be null.  A table is stored at once.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    parts = ranged.groupBy(*group, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group,
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("n"),
    )
    joined = ranged.join(parts, [*group, "_range"])
    return joined.select(*df.columns, (F.col("_id") + F.col("_shift")).alias("pos"), "n")
