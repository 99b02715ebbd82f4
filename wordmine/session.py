"""Helpers around the Spark session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from time import perf_counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Owners of stored tables, innermost last: each is a list of paths.
_OWNERS: list[list[str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as named by ``spark.checkpoint.dir``.

    It must be set on a cluster.  On one machine a folder in the warehouse serves
    where it is not.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that all executors can reach"
            )
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_wordmine"
    return folder.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are stored inside, also when the job fails.

    A job returns a DataFrame that still reads its stored tables, so write or
    collect the result inside::

        with scratch(spark):
            discover_v1(docs, stopwords).write.parquet(out)
    """
    own: list[str] = []
    _OWNERS.append(own)
    try:
        yield
    finally:
        _OWNERS.remove(own)
        for path in own:
            delete(spark, path)


def file_system(spark: SparkSession, folder: str):
    """What makes paths, and the file system that ``folder`` is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    where, fs = file_system(spark, path)
    fs.delete(where(path), True)


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path below the shared folder that nothing uses yet.

    The innermost ``scratch`` owns it; without one it stays until it is deleted.
    """
    path = f"{checkpoint_dir(spark)}/wordmine-{kind}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


#: Figures being collected, innermost last: each is a list of stages.
_FIGURES: list[list[dict]] = []


@contextmanager
def figures() -> Iterator[list[dict]]:
    """Collect the figures of the stages that are stored inside, one dict each::

        with figures() as stages:
            words = discover_v2(docs, stopwords)
        # [{'stage': 'ngrams', 'rows': ..., 'occurrences': ..., 'characters': ..., 'seconds': ...}, ...]

    The counts are observed while a stage is written, so no job runs for them.
    """
    own: list[dict] = []
    _FIGURES.append(own)
    try:
        yield own
    finally:
        _FIGURES.remove(own)


def materialize(
    df: DataFrame, compression: str = "snappy", stage: str | None = None, **counts: Column
) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    Used where one result feeds several later steps.  The written table
    survives lost executors, is read column by column, and tells the planner
    its true size, so that Spark broadcasts it only below its own limit.  This
    runs a job at once, and so does every function that calls it.

    Inside ``figures`` the rows of a named ``stage``, and aggregates given as
    ``counts``, are observed as it is written.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    written, seen, start = df, None, perf_counter()
    if stage is not None and _FIGURES:
        seen = Observation()
        written = df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in counts.items()])
    written.write.option("compression", compression).parquet(path)
    if seen is not None:
        seconds = round(perf_counter() - start, 3)
        _FIGURES[-1].append({"stage": stage, **seen.get, "seconds": seconds})
    return spark.read.schema(df.schema).parquet(path)


def running_sums(
    df: DataFrame, group: list[str], order: list[str], sums: list[str]
) -> DataFrame:
    """Add ``<name>_upto`` for each of ``sums``: its sum up to the row, in order.

    Rows are dealt to ranges of (group, order) and added up inside each; only a
    row per group and range meets its like in one place.  So a group may be of
    any size.  ``order`` must be unique within a group.
    """
    ranged = df.repartitionByRange(*group, *order)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*group, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    parts = parts.select(
        *group, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    out = ranged.join(parts, [*group, "_range"])
    added = {f"{c}_upto": F.sum(c).over(inside) + F.col(f"_{c}") for c in sums}
    return out.withColumns(added).select(*df.columns, *added)


def together(df: DataFrame, by: str) -> DataFrame:
    """Bring the rows with equal ``by`` together: in one partition, one after the other."""
    return df.repartition(by).sortWithinPartitions(by)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Redistribute a scan that has too few splits to use the cluster.

    With ``partitions`` given it is a minimum.  Otherwise the scan is left
    alone unless its splits could not even fill half of the task slots, which
    is never so for a corpus larger than the cluster.  Only the layout changes,
    never a result.  This looks at the scan's splits through ``df.rdd``, which
    Spark Connect does not offer.
    """
    splits = df.rdd.getNumPartitions()
    if partitions is None:
        slots = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(slots) if splits * 2 <= slots else df
    return df.repartition(partitions) if splits < partitions else df
