"""N-gram generation and counting.

An n-gram dictionary is a DataFrame ``(word string, freq bigint)`` with one row
per distinct n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions import text as tx
from wordmine.functions.packed import counting
from wordmine.operators.clean import weighted_clauses


def _windows(df: DataFrame, col: str, n: int) -> DataFrame:
    """One row per position with the up to n characters from there on, as ``s``."""
    others = [c for c in df.columns if c != col]
    pieces = df.select(*others, F.explode(tx.chunks(col, n)).alias("s"))
    # sequence(1, 0) would count down, so empty pieces have to go.  A filter on
    # the text instead would be pushed to the scan, with all that made the text.
    pieces = pieces.where(F.col("s") != "")
    starts = F.least(F.length("s"), F.lit(tx.CHUNK))
    placed = pieces.select(
        *others, "s", F.explode(F.sequence(F.lit(1), starts)).alias("at")
    )
    return placed.select(*others, F.substring("s", F.col("at"), F.lit(n)).alias("s"))


def _prefixes(windows: DataFrame, longest: int | None = None) -> DataFrame:
    """One row per non-empty prefix of ``s``, as ``word``."""
    others = [c for c in windows.columns if c != "s"]
    size = F.length("s")
    if longest is not None:
        size = F.least(size, F.lit(longest))
    sized = windows.select(
        *others, "s", F.explode(F.sequence(F.lit(1), size)).alias("size")
    )
    return sized.select(
        *others, F.substring("s", F.lit(1), F.col("size")).alias("word")
    )


def _different(df: DataFrame, by: str, col: str, n: int, least: int, prefixes: bool, name: str) -> DataFrame:
    """Windows that occur in the texts of each ``by``: ``by, <name>, n, whole, digest``."""
    kind = dict(df.dtypes)[by]
    rows = df.select(F.col(by).alias("key"), col).mapInArrow(
        counting(n, least, prefixes, digest=True),
        f"key {kind}, word string, n long, whole boolean, digest long",
    )
    return rows.withColumnsRenamed({"key": by, "word": name})


def explode_ngrams(
    clauses: DataFrame, n: int, col: str = "clause", by: str | None = None
) -> DataFrame:
    """All substrings of length 1..n, one row per occurrence, as ``word``.

    Other columns (a document id, a weight) are kept.

    With ``by``, a column whose equal values stand together in one partition
    (``session.together``), equal n-grams of a value of ``by`` are counted where
    they are made, before any of them moves: ``by, word, n, whole, digest``, the
    last one being the first 28 bits of the word's MD5.  Where ``whole`` is false
    (``by`` has more text than a task handles at once), ``n`` has to be summed.
    """
    if by is not None:
        return _different(clauses, by, col, n, 1, True, "word")
    return _prefixes(_windows(clauses, col, n))


def _dictionary(df: DataFrame, col: str, n: int, weight: Column) -> DataFrame:
    """Count all substrings of length 1..n in two steps.

    First the windows of width n, one per character; then their prefixes.  An
    n-gram row is written for each *distinct* window only, so the first shuffle
    carries one row per character instead of n, and the second one what is left
    after equal windows from the whole corpus have met.
    """
    counted = _windows(df, col, n).groupBy("s").agg(F.sum(weight).alias("n"))
    return _prefixes(counted).groupBy("word").agg(F.sum("n").alias("freq"))


def count_ngrams(clauses: DataFrame, n: int, weight: str | None = None) -> DataFrame:
    """N-gram dictionary of all substrings of length 1..n.

    Without a ``weight`` column equal clauses are counted first, so that each
    distinct clause is cut up only once.
    """
    if weight is None:
        clauses = clauses.groupBy("clause").agg(F.count(F.lit(1)).alias("w"))
        weight = "w"
    return _dictionary(clauses.select("clause", weight), "clause", n, F.col(weight))


def corpus_ngrams(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """N-gram dictionary of a raw corpus."""
    return count_ngrams(weighted_clauses(df, text_col), n, weight="w")


def shingles(
    washed: DataFrame, w: int, pad: str = tx.PAD, col: str = "text", by: str | None = None
) -> DataFrame:
    """One substring of width w+1 per position, padded at the end, as ``s``.

    With ``by``, equal ones are counted as in ``explode_ngrams``: ``by, s, n, whole,
    digest``.
    """
    more = F.when(F.col(col) != "", F.lit(pad * w)).otherwise("")
    padded = washed.withColumn(col, F.concat(F.col(col), more))
    if by is not None:
        return _different(padded, by, col, w + 1, w + 1, False, "s")
    return _windows(padded, col, w + 1).where(F.length("s") == w + 1)


def count_shingles(
    shingles: DataFrame, w: int, min_freq: int, pad: str = tx.PAD
) -> DataFrame:
    """Frequent words of length 2..w, counted from shingles."""
    distinct = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return (
        _prefixes(distinct, w)
        .where((F.length("word") > 1) & ~F.col("word").endswith(pad))
        .groupBy("word")
        .agg(F.sum("n").alias("freq"))
        .where(F.col("freq") >= min_freq)
    )


def padded_ngrams(
    washed: DataFrame, w: int, pad: str = tx.PAD, col: str = "text"
) -> DataFrame:
    """Dictionary of length 1..w+1 in which each text end counts as a character.

    Every text gets one pad in front and one behind; an n-gram holding a pad
    only says which neighbour the rest of it had.  Whole texts have many windows,
    so equal n-grams of a slice of texts are counted before they become rows.
    """
    # An empty text becomes two pads; what that gives is dropped below.
    padded = washed.select(F.concat(F.lit(pad), F.col(col), F.lit(pad)).alias(col))
    counted = padded.mapInArrow(counting(w + 1, 1, True), "word string, n long")
    grams = counted.groupBy("word").agg(F.sum("n").alias("freq"))
    return grams.where(~F.col("word").isin(pad, pad * 2))


def reverse_grams(grams: DataFrame) -> DataFrame:
    """The dictionary with every n-gram written backwards."""
    return grams.withColumn("word", F.reverse("word"))


def unigrams(grams: DataFrame) -> DataFrame:
    """The single characters of a dictionary."""
    return grams.where(F.length("word") == 1)


def corpus_length(clauses: DataFrame) -> DataFrame:
    """One row ``(total)``: the number of characters in all clauses."""
    return clauses.agg(
        F.coalesce(F.sum(F.length("clause")), F.lit(0)).cast("bigint").alias("total")
    )


def length_from_grams(grams: DataFrame) -> DataFrame:
    """The same from a dictionary: each character is one unigram occurrence."""
    return unigrams(grams).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"))


def total_occurrences(grams: DataFrame) -> DataFrame:
    """One row ``(occurrences)``: the sum of all n-gram frequencies."""
    return grams.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("occurrences"))
