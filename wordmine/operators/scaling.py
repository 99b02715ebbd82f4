"""Bringing the features of the selected words to a common scale.

These read their input twice (once for the moments); pass a table or a
materialized result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("freedom", "cohesion", "freq")


def feature_moments(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """One row with ``<col>_mean`` and ``<col>_spread`` for each column.

    The spread is the root of the sum of squared deviations, divided by the
    number of rows; it is not the standard deviation.
    """
    n = F.count(F.lit(1))
    out = []
    for c in cols:
        out.append(F.avg(c).alias(f"{c}_mean"))
        out.append(
            F.try_divide(F.stddev_pop(c), F.sqrt(n)).alias(f"{c}_spread")
        )
    return df.agg(*out)


def _replaced(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else c for c in df.columns])


def zscale(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Subtract the mean and divide by the spread; null for a constant column."""
    row = feature_moments(df, cols).select(F.struct("*")).scalar()
    return _replaced(
        df,
        {
            c: F.try_divide(
                F.col(c) - row.getField(f"{c}_mean"), row.getField(f"{c}_spread")
            )
            for c in cols
        },
    )


def minmax(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Scale each column to 0..1; null for a constant column."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in cols for f in (F.min, F.max)]
    row = df.agg(*ends).select(F.struct("*")).scalar()
    out = {}
    for c in cols:
        low, high = row.getField(f"{c}_min"), row.getField(f"{c}_max")
        out[c] = F.try_divide(
            (F.col(c) - low).cast("double"), (high - low).cast("double")
        )
    return _replaced(df, out)


def squash(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """``1 - exp(-x)`` of the min-max scaled columns."""
    return _replaced(
        minmax(df, cols), {c: F.lit(1.0) - F.exp(-F.col(c)) for c in cols}
    )


def score(df: DataFrame, weights: Mapping[str, float], log: bool = False) -> DataFrame:
    """Add ``score``, a weighted sum of the min-max scaled features.

    ``log`` compresses the features with ``ln(1 + x)`` before scaling.
    """
    def raw(c: str) -> Column:
        return F.log1p(c) if log else F.col(c)

    ranged = minmax(
        df.select("*", *[raw(c).alias(f"_{c}") for c in weights]),
        [f"_{c}" for c in weights],
    )
    terms = [F.col(f"_{c}") * F.lit(float(w)) for c, w in weights.items()]
    return ranged.select(*df.columns, sum(terms, F.lit(0.0)).alias("score"))
