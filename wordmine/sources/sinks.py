"""Writing words and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.session import file_system

#: Names the tables of a set of stages, one to a line.
MANIFEST = "stages.txt"


def write_words(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write selected words; an existing path is refused."""
    df.write.mode("error").format(fmt).save(path)


def write_stages(stages: Mapping[str, DataFrame], folder: str) -> None:
    """Write each named intermediate table below ``folder``, all of them or none.

    The tables are written aside first.  Only when the last one is complete they
    move to their places, and a manifest that names them is written at the very end;
    a set without one is not read (``read_stages``).  If a table fails, what was
    written aside is deleted.  An existing table or manifest is refused.
    """
    if not stages:
        return
    spark = next(iter(stages.values())).sparkSession
    folder = folder.rstrip("/")
    aside = f"{folder}/_{uuid.uuid4().hex}"
    path, fs = file_system(spark, folder)
    for name in (*stages, MANIFEST):
        if fs.exists(path(f"{folder}/{name}")):
            raise FileExistsError(f"{folder}/{name} exists")
    try:
        for name, df in stages.items():
            write_words(df, f"{aside}/{name}")
        for name in stages:
            if not fs.rename(path(f"{aside}/{name}"), path(f"{folder}/{name}")):
                raise OSError(f"{folder}/{name} could not be put in place")
    finally:
        fs.delete(path(aside), True)
    out = fs.create(path(f"{folder}/{MANIFEST}"), False)
    out.write(bytearray("\n".join(stages).encode()))
    out.close()


def read_stages(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a complete set, by name."""
    folder = folder.rstrip("/")
    path, fs = file_system(spark, folder)
    if not fs.exists(path(f"{folder}/{MANIFEST}")):
        raise FileNotFoundError(f"{folder} holds no complete set of stages")
    names = [r["value"] for r in spark.read.text(f"{folder}/{MANIFEST}").collect()]
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_ranked(df: DataFrame, path: str) -> None:
    """Write words as CSV text in order of falling frequency.

    The part files are in rank order, so reading them by name gives the whole
    ranking.  A small result is one file, because adaptive execution joins
    small partitions; a large one is never forced through a single task.
    """
    df.orderBy(F.desc("freq"), "word").write.mode("error").csv(path)
