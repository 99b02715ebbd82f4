"""Column expressions for the statistics of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Freedom is rounded to this many digits where it is computed.  The order in
#: which a cluster adds numbers changes the last bits; rounding keeps limits,
#: ties and ranks the same from run to run.
FREEDOM_DIGITS = 9


def entropy(kinds: Column, total: Column, weighted_log: Column) -> Column:
    """Entropy (natural log) of neighbour counts from three plain sums.

    ``kinds`` is the number of distinct neighbours, ``total`` the sum of their
    counts c and ``weighted_log`` the sum of c * ln(c).

    The result is 0 exactly when there are fewer than two neighbours.  A
    positive value too small for the rounding is lifted to the smallest
    positive one, so that "freedom > 0" means the same at every corpus size.
    """
    value = F.ln(total) - weighted_log / total
    smallest = F.lit(10.0**-FREEDOM_DIGITS)
    return F.when(
        kinds > 1, F.greatest(F.round(value, FREEDOM_DIGITS), smallest)
    ).otherwise(F.lit(0.0))


def split_strength(scaled: Column, left: Column, right: Column) -> Column:
    """How much more often two parts meet than by chance.

    ``scaled`` is the frequency of the whole times the corpus length, as double.
    Dividing it twice, never multiplying the parts, keeps all numbers in range.
    """
    return scaled / left / right


def ksi(product: Column, total: Column, length: Column) -> Column:
    """Count expected if the characters were independent."""
    return product / F.pow(total, length - 1)


def dice(freq: Column, char_sum: Column, length: Column) -> Column:
    return length * freq / char_sum


def mutual_information(
    freq: Column, product: Column, total: Column, length: Column
) -> Column:
    return F.ln(freq / product / total) + length * F.ln(total)


def scp(freq: Column, product: Column, length: Column) -> Column:
    """Symmetric conditional probability."""
    return F.pow(freq.cast("double"), length) / product


def zscore(freq: Column, expected: Column, total: Column) -> Column:
    return F.try_divide(
        freq - expected, F.sqrt(expected * (F.lit(1.0) - expected / total))
    )


def tscore(freq: Column, expected: Column, total: Column) -> Column:
    return F.try_divide(freq - expected, F.sqrt(freq * (F.lit(1.0) - freq / total)))
