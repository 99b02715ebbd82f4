"""Column expressions for cleaning raw text and cutting it into n-grams.

Everything here is a built-in Spark expression, so it stays inside generated
JVM code.  Lambdas over arrays are avoided: Spark interprets them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a clause.
CLAUSE_MARKS = ",，.。!！?？;；:：'‘’\"”“、(（)）<《>》[【】]{} \t\r\n"

# The characters that may stay inside a clause, as the inside of
# a regex class.  \p{Alnum} is a-z, A-Z and 0-9.
CJK = "一-龥"
LATIN = r"\p{Alnum}*\-.\\"

# Text that breaks a clause after cleaning (escape sequences
# written out as letters, and runs of eight or more digits).
ESCAPES = r"\\r\\n|\\n|\\t"
LONG_DIGITS = "[0-9]{8,}"

# Digits in other scripts and what they stand for.
OTHER_DIGITS = "０１２３４５６７８９〇零一二三四五六七八九"
PLAIN_DIGITS = "012345678900123456789"

#: Stands for "the text starts or ends here"; no cleaned text contains it.
PAD = "\u0001"

#: Start positions per piece of a text that is cut into n-grams.
CHUNK = 64


def _mark_class() -> str:
    # Java tests the members of a class one after the other.  With the wide
    # characters behind one range test, ASCII text skips all of them.
    narrow = "".join(f"\\x{ord(c):02x}" for c in CLAUSE_MARKS if ord(c) < 128)
    wide = "".join(c for c in CLAUSE_MARKS if ord(c) >= 128)
    return f"[{narrow}[\\u0080-\\uffff&&[{wide}]]]"


# Decimal digits that fit in one UTF-16 unit.
_DIGIT = r"[\p{Nd}&&[\x{0}-\x{FFFF}]]"

# A run of clause marks; a full stop between two digits is not one of them.
CLAUSE_END = rf"(?:{_mark_class()}(?<!{_DIGIT}\.(?={_DIGIT})))+"

_KEPT = rf"{LATIN}[\u0080-\uffff&&[{CJK}]]"
NOT_MEANINGFUL = f"[^{_KEPT}]"
NOT_MEANINGFUL_OR_NEWLINE = rf"[^\n{_KEPT}]"


def segments(text: Column | str) -> Column:
    """Array of the pieces between clause marks; pieces may be empty."""
    return F.split(text, CLAUSE_END, -1)


def meaningful(text: Column | str) -> Column:
    """Drop every character that cannot be part of a word."""
    return F.regexp_replace(text, NOT_MEANINGFUL, "")


def clause_array(text: Column | str) -> Column:
    """Array of the non-empty clauses of a raw text, in order."""
    # A newline is a clause mark itself, so it can stand for all of them
    # while the other characters are dropped.
    marked = F.regexp_replace(text, CLAUSE_END, "\n")
    kept = F.regexp_replace(marked, NOT_MEANINGFUL_OR_NEWLINE, "")
    return F.array_remove(F.split(kept, rf"\n|{ESCAPES}|{LONG_DIGITS}", -1), "")


def washed(text: Column | str, alphabet: str = CJK) -> Column:
    """Keep only the characters of ``alphabet`` (the inside of a regex class)."""
    return F.regexp_replace(text, f"[^{alphabet}]+", "")


def unified(text: Column | str, case: bool = False, digits: bool = False) -> Column:
    """Lower-case letters and/or write all digits as 0-9."""
    out = F.col(text) if isinstance(text, str) else text
    if case:
        out = F.lower(out)
    if digits:
        out = F.translate(out, OTHER_DIGITS, PLAIN_DIGITS)
    return out


def chunks(text: Column | str, n: int) -> Column:
    """Array of pieces of at most CHUNK + n - 1 characters.

    Each piece holds the n characters that follow its first CHUNK positions, so
    pieces overlap by n - 1.  ``substring`` counts characters from the start of
    a string; on pieces of fixed size, cutting up a text stays linear in its
    length, and no row ever holds all n-grams of one text.
    """
    piece = f"(?s)(?=(.{{1,{CHUNK + n - 1}}})).{{1,{CHUNK}}}"
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(col) <= CHUNK, F.array(col)).otherwise(
        F.regexp_extract_all(col, F.lit(piece), F.lit(1))
    )


def characters(word: Column | str) -> Column:
    """Array of the characters of a word."""
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
