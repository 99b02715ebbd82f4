"""From raw text to clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.functions import text as tx


def _pieces(df: DataFrame, col: str, parts) -> DataFrame:
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(parts).alias(col)).where(F.col(col) != "")


def split_clauses(df: DataFrame, col: str = "text") -> DataFrame:
    """One row per piece between clause marks; decimal points do not split."""
    return _pieces(df, col, tx.segments(col))


def keep_meaningful(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop characters that cannot be part of a word; neighbours close up."""
    return df.withColumn(col, tx.meaningful(col))


def split_escapes(df: DataFrame, col: str = "text") -> DataFrame:
    r"""Split at escape sequences written out as letters: ``\r\n \n \t``."""
    return _pieces(df, col, F.split(col, tx.ESCAPES, -1))


def split_long_digits(df: DataFrame, col: str = "text") -> DataFrame:
    """Remove runs of eight or more digits and split there."""
    return _pieces(df, col, F.split(col, tx.LONG_DIGITS, -1))


def clauses(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All clauses as ``(doc_id, pos, clause)``, ``pos`` counting from 0."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(tx.clause_array(text_col)).alias("pos", "clause"),
    )


def weighted_clauses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Clauses with the number of times they occur: ``(clause, w)``.

    Raw pieces are counted first (with map-side combine, so a piece that makes
    up a third of the corpus costs one row per task), and only distinct pieces
    are cleaned.  Two pieces that differ in dropped characters only give the
    same clause twice; the weights add up all the same.
    """
    counted = (
        split_clauses(df.select(text_col), text_col)
        .groupBy(F.col(text_col).alias("clause"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    cleaned = F.split(tx.meaningful("clause"), f"{tx.ESCAPES}|{tx.LONG_DIGITS}", -1)
    return counted.select(F.explode(cleaned).alias("clause"), "w").where("clause <> ''")


def wash(df: DataFrame, alphabet: str = tx.CJK, col: str = "text") -> DataFrame:
    """Reduce each text to the characters of ``alphabet``, joined up."""
    return df.withColumn(col, tx.washed(col, alphabet))


def unify(
    df: DataFrame, col: str = "text", case: bool = False, digits: bool = False
) -> DataFrame:
    """Unify letter case and/or digits (full-width and Chinese ones become 0-9)."""
    return df.withColumn(col, tx.unified(col, case, digits))
