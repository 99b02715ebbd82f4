"""Rules that turn candidates with features into words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_all3(
    df: DataFrame, min_freq: int, min_cohesion: float, min_freedom: float
) -> DataFrame:
    """All three features reach their limit."""
    return df.where(
        (F.col("freq") >= min_freq)
        & (F.col("cohesion") >= min_cohesion)
        & (F.col("freedom") >= min_freedom)
    )


def select_band(
    df: DataFrame, min_freedom: float, cohesion_low: float, cohesion_high: float
) -> DataFrame:
    """Free enough, and cohesion within a band (limits included)."""
    return df.where(
        (F.col("freedom") >= min_freedom)
        & F.col("cohesion").between(cohesion_low, cohesion_high)
    )


def select_envelope(df: DataFrame, envelope: DataFrame) -> DataFrame:
    """Freedom and cohesion within the one-row ``envelope`` (limits included).

    An envelope of nulls (no known word in the corpus) selects nothing.
    """
    limits = envelope.select(F.struct("*")).scalar()
    return df.where(
        F.col("freedom").between(
            limits.getField("freedom_low"), limits.getField("freedom_high")
        )
        & F.col("cohesion").between(
            limits.getField("cohesion_low"), limits.getField("cohesion_high")
        )
    )


def select_min_cohesion(df: DataFrame, min_cohesion: float = 20) -> DataFrame:
    """Cohesion reaches its limit."""
    return df.where(F.col("cohesion") >= min_cohesion)


def select_strict(
    df: DataFrame, freedom: float = 1.7, cohesion: float = 23
) -> DataFrame:
    """Freedom and cohesion both above their limit."""
    return df.where((F.col("freedom") > freedom) & (F.col("cohesion") > cohesion))


def select_vote(
    df: DataFrame,
    min_freq: int,
    min_freedom: float,
    cohesion_low: float,
    cohesion_high: float,
) -> DataFrame:
    """At least two of: frequent, free, cohesion inside an open band."""
    frequent = F.col("freq") >= min_freq
    free = F.col("freedom") >= min_freedom
    tight = (F.col("cohesion") > cohesion_low) & (F.col("cohesion") < cohesion_high)
    return df.where((frequent & tight) | (frequent & free) | (tight & free))
