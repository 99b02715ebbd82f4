"""Freedom of a word: entropy of its left and right neighbours.

The neighbours of ``w`` are the dictionary entries one character longer, so a
range scan becomes a grouping: on the entry without its last character for the
right side, without its first for the left.  A group has at most one row per
character of the alphabet and is combined before the shuffle, so no group can
get hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.functions.measures import entropy
from wordmine.functions.text import PAD

#: Bits that tell words that may be frequent from those that are not: half a megabyte.
FILTER_BITS = 1 << 22


def _stem(side: str) -> Column:
    """The entry without the neighbour on ``side``."""
    if side == "right":
        return F.expr("substring(word, 1, length(word) - 1)")
    return F.expr("substring(word, 2)")


def _entropy_of(when: Column | None = None) -> Column:
    def only(value: Column) -> Column:
        return value if when is None else F.when(when, value)

    freq = F.col("freq").cast("double")
    return entropy(
        F.count(only(F.col("freq"))),
        F.sum(only(freq)),
        F.sum(only(freq * F.ln(freq))),
    )


def _one_side(grams: DataFrame, side: str) -> DataFrame:
    longer = grams.where(F.length("word") > 1)
    return (
        longer.select(_stem(side).alias("word"), "freq")
        .groupBy("word")
        .agg(_entropy_of().alias(f"{side}_freedom"))
    )


def right_freedom(grams: DataFrame) -> DataFrame:
    """``(word, right_freedom)`` of every entry that has a right neighbour."""
    return _one_side(grams, "right")


def left_freedom(grams: DataFrame) -> DataFrame:
    """``(word, left_freedom)`` of every entry that has a left neighbour."""
    return _one_side(grams, "left")


def stems(grams: DataFrame, side: str) -> DataFrame:
    """Every entry as an extension of its stem: ``(word, extension, extension_freq)``."""
    return grams.where(F.length("word") > 1).select(
        _stem(side).alias("word"),
        F.col("word").alias("extension"),
        F.col("freq").alias("extension_freq"),
    )


def extensions(words: DataFrame, grams: DataFrame, side: str = "right") -> DataFrame:
    """All one-character extensions: ``(word, extension, extension_freq)``."""
    return words.select("word").join(stems(grams, side), "word")


def freedom(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """Add ``right_freedom``, ``left_freedom`` and their minimum ``freedom``.

    A side without neighbours counts as 0.
    """
    # Only neighbours of the candidates are grouped.
    return freedom_of(candidates, lambda side: extensions(candidates, grams, side))


def freedom_of(candidates: DataFrame, extended: Callable[[str], DataFrame]) -> DataFrame:
    """The same, given the extensions of the candidates on a side."""
    right, left = (
        extended(side)
        .withColumnRenamed("extension_freq", "freq")
        .groupBy("word")
        .agg(_entropy_of().alias(f"{side}_freedom"))
        for side in ("right", "left")
    )
    zero = F.lit(0.0)
    return (
        candidates.join(right, "word", "left")
        .join(left, "word", "left")
        .withColumn("right_freedom", F.coalesce("right_freedom", zero))
        .withColumn("left_freedom", F.coalesce("left_freedom", zero))
        .withColumn("freedom", F.least("right_freedom", "left_freedom"))
    )


def word_filter(grams: DataFrame, max_len: int, min_freq: int, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test that holds for every frequent word of 2 to ``max_len`` characters.

    It also holds for some others: each word sets one of ``bits`` bits (a multiple
    of 64) that its hash names.  The bits are one array, of a size that does not
    grow with the corpus, which comes to the tasks with the plan.
    """
    place = lambda word: F.pmod(F.xxhash64(word), F.lit(bits))
    frequent = grams.where((F.col("freq") >= min_freq) & F.length("word").between(2, max_len))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    slots = frequent.select(place(F.col("word")).alias("place")).groupBy(F.shiftright("place", 6).alias("slot"))
    slots = slots.agg(F.bit_or(bit).alias("set"))
    every = grams.sparkSession.range(bits // 64).withColumnRenamed("id", "slot").join(slots, "slot", "left")
    row = F.struct("slot", F.coalesce("set", F.lit(0).cast("bigint")).alias("set"))
    table = every.agg(F.array_sort(F.collect_list(row)).getField("set").alias("sets")).scalar()

    def maybe(word: Column) -> Column:
        at = place(word)
        return F.getbit(table[F.shiftright(at, 6).cast("int")], at.bitwiseAND(63).cast("int")) == 1

    return maybe


def word_statistics(
    grams: DataFrame,
    max_len: int,
    min_freq: int,
    pad: str | None = None,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """Frequency and freedom of all frequent entries in one grouping.

    Every dictionary entry reports to up to three words: to itself with its
    frequency, and to its two stems as one of their neighbours.  One shuffle on
    the word then replaces two groupings and two joins.  Stems that are surely not
    frequent (``word_filter``) get no reports, as nothing is asked of them; so
    ``grams`` is read twice and should be a stored table.  The result holds the
    entries up to ``max_len`` characters with ``freq >= min_freq`` and all single
    characters (whose frequencies add up to the corpus length); it is also the
    dictionary that cohesion needs, since a part is at least as frequent as the
    whole.

    Entries containing ``pad`` are neighbours only.  Single characters are no
    candidates; their freedom is not computed and null.
    """
    size = F.length("word")
    sides = ("right_freedom", "left_freedom")
    is_word = (size <= max_len) & ((F.col("freq") >= min_freq) | (size == 1))
    # Stems of one character are no candidates, their freedom is not needed.
    is_neighbour = (size >= 3) & (size <= max_len + 1)
    asked = word_filter(grams, max_len, min_freq, bits)

    def report(when: Column, to: Column, role: int) -> Column:
        return F.struct(F.when(when, to).alias("word"), F.lit(role).alias("role"))

    reports = F.array(
        report(is_word, F.col("word"), 0),
        report(is_neighbour, _stem("right"), 1),
        report(is_neighbour, _stem("left"), 2),
    )
    rows = grams.select("freq", F.inline(reports)).where(F.col("word").isNotNull())
    rows = rows.where((F.col("role") == 0) | asked(F.col("word")))
    if pad is not None:
        rows = rows.where(~F.col("word").contains(pad))
    role = F.col("role")
    return (
        rows.groupBy("word")
        .agg(
            F.sum(F.when(role == 0, F.col("freq"))).alias("freq"),
            _entropy_of(role == 1).alias("right_freedom"),
            _entropy_of(role == 2).alias("left_freedom"),
        )
        .where(F.col("freq").isNotNull())
        .withColumns({c: F.when(size > 1, F.col(c)) for c in sides})
        .withColumn("freedom", F.when(size > 1, F.least(*sides)))
    )


def freedom_padded(
    padded_grams: DataFrame, w: int, min_freq: int, pad: str = PAD
) -> DataFrame:
    """Freedom with text ends counted as a neighbour, of words of length 2..w.

    With the pads in the dictionary every occurrence has a neighbour on each
    side, so the neighbour counts of a word add up to its frequency.  The
    dictionary is read twice (see ``word_statistics``).
    """
    stats = word_statistics(padded_grams, w, min_freq, pad)
    return stats.where((F.length("word") > 1) & (F.col("freq") >= min_freq))
