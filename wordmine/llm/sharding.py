"""Documents in shards of near equal bytes, by sampled splitters.

Rows are ordered by a hash of the text, then doc_id, so that equal texts stand
together.  A size-weighted sample of keys gives quantiles, which cut the order
into ranges; a range with too many rows (one text in very many copies) is dealt
on by a hash of doc_id.  Sums within each range, and over the ranges before it,
give every row its place in the whole order, and the place in bytes its shard.
So the sample only spreads the work: shards are near equal whatever it is.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.session import materialize

#: Keys drawn, about, and rows that make a range overfull, as a multiple of the mean.
SAMPLE_KEYS = 20_000
OVERFULL = 2.0
#: Bytes that every row counts beside its text.
ROW_BYTES = 16


def sized_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, h``; a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # 53 bits, so that the key is exact as a double.
        F.shiftrightunsigned(F.xxhash64(text), 11).cast("double").alias("h"),
    )


def splitters(rows: DataFrame, total: int, ranges: int, keys: int = SAMPLE_KEYS) -> list[float]:
    """Quantiles of a size-weighted sample of about ``keys`` keys, drawn by a hash."""
    chance = F.col("size") * (keys / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "h", F.lit("draw")), F.lit(1 << 30)) < chance * (1 << 30))
    sample = sorted(r["h"] for r in drawn.select("h").collect())
    cuts = {sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set()
    return [float("-inf"), *sorted(cuts), float("inf")]


def shard(docs: DataFrame, shards: int = 40, ranges: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, range`` of every row.

    The sizes of two shards differ by two rows' sizes at most.  ``slot`` counts
    the rows of a shard from 0.  A null text counts as empty.  Rows with the same
    doc_id and text may change places.
    """
    rows = materialize(sized_rows(docs))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    n_bytes, n = total["bytes"] or 0, total["n"]
    if ranges is None:
        ranges = max(4 * shards, min(20_000, n // 100_000))
    cuts = splitters(rows, n_bytes, ranges)
    if len(cuts) > 2:
        split = Bucketizer(splits=cuts, inputCol="h", outputCol="b")
        placed = split.transform(rows).withColumn("b", F.col("b").cast("int"))
    else:
        placed = rows.withColumn("b", F.lit(0))
    # One row per range: some thousands at most.
    held = placed.groupBy("b").agg(F.count("*").alias("n"))
    most = max(1.0, OVERFULL * n / max(1, len(cuts) - 1))
    parts = held.select(F.col("b").alias("r"), F.ceil(F.col("n") / most).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), F.col("b") == F.col("r"))
    placed = placed.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))

    inside = Window.partitionBy("b", "s").orderBy("h", "doc_id", "text_crc32")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumns(
        {"place": F.row_number().over(inside) - 1, "through": F.sum("size").over(upto)}
    )
    sums = placed.groupBy("b", "s").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # Also one row per (sub)range, of which there are at most twice as many.
    before = Window.orderBy("b", "s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("b").alias("pb"),
        F.col("s").alias("ps"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("skip_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
    )
    counted = counted.join(
        F.broadcast(sums), (F.col("b") == F.col("pb")) & (F.col("s") == F.col("ps"))
    )
    middle = F.col("skip_bytes") + F.col("through") - F.col("size") / 2
    shard_of = F.least(F.floor(middle * shards / max(n_bytes, 1)), F.lit(shards - 1)).cast("int")
    counted = materialize(
        counted.select(
            "doc_id",
            "size",
            "text_crc32",
            shard_of.alias("shard"),
            (F.col("skip") + F.col("place")).cast("long").alias("rank"),
            F.col("b").alias("range"),
        )
    )
    first = counted.groupBy(F.col("shard").alias("own")).agg(F.min("rank").alias("first"))
    return counted.join(F.broadcast(first), F.col("shard") == F.col("own")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "range",
    )
