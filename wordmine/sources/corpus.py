"""Corpus and word-list scans."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.session import spread

_JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"
_REPLACE_MALFORMED = "spark.sql.legacy.codingErrorAction"


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Allow charsets such as GBK in expressions and writers made inside.

    The setting belongs to the session, so plans that need it should not be
    built in several threads of one session at a time.
    """
    before = spark.conf.get(_JAVA_CHARSETS)
    spark.conf.set(_JAVA_CHARSETS, "true")
    try:
        yield
    finally:
        spark.conf.set(_JAVA_CHARSETS, before)


def _decoded(spark: SparkSession, lines: DataFrame, encoding: str, malformed: str) -> DataFrame:
    # The text source passes the bytes of a line through unchanged, so they can
    # be decoded afterwards and files still split at any line.
    raw = F.col("value").cast("binary")
    replaced = "true" if malformed == "replace" else "false"
    before = spark.conf.get(_REPLACE_MALFORMED)
    spark.conf.set(_REPLACE_MALFORMED, replaced)
    try:
        with java_charsets(spark):
            return lines.select(F.decode(raw, encoding).alias("value"))
    finally:
        spark.conf.set(_REPLACE_MALFORMED, before)


def read_corpus(
    spark: SparkSession,
    path: str | list[str],
    partitions: int | None = None,
    encoding: str = "UTF-8",
    fmt: str = "text",
    whole_files: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    malformed: str = "fail",
) -> DataFrame:
    """Scan a corpus, one path or several, as ``(doc_id bigint, text string)``.

    ``fmt='text'``: one document per line, or per file with ``whole_files``.
    ``encoding`` may be any charset that keeps the newline byte for newlines
    (UTF-8, GBK, ...).  ``fmt='parquet'`` (or another table format): the two
    named columns.  ``partitions`` is a minimum number of partitions.

    ``whole_files`` makes one row per file, so a file must be smaller than 2 GB.
    Bytes that are no text in ``encoding`` fail the job; with
    ``malformed='replace'`` each becomes the replacement character.
    """
    if fmt != "text":
        docs = spark.read.format(fmt).load(path)
        docs = docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
        )
        return spread(docs, partitions)
    lines = spark.read.text(path, wholetext=whole_files)
    if encoding.upper() not in ("UTF-8", "UTF8"):
        lines = _decoded(spark, lines, encoding, malformed)
    docs = lines.select(
        F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text")
    )
    return spread(docs, partitions)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Scan a word list, one word per line, as distinct ``(word string)``.

    Words are taken as they are (no trimming); a byte-order mark is dropped.
    """
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()
