"""Plain Python counterparts, used to check the Spark results on small data."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

MARKS = set(",，.。!！?？;；:：'‘’\"”“、(（)）<《>》[【】]{} \t\r\n")


def is_kept(c: str) -> bool:
    return "一" <= c <= "龥" or (c.isascii() and c.isalnum()) or c in "*-.\\"


def is_digit(c: str) -> bool:
    return unicodedata.category(c) == "Nd"


def clauses(text: str) -> list[str]:
    pieces, now = [], []
    for i, c in enumerate(text):
        decimal = (
            c == "."
            and 0 < i < len(text) - 1
            and is_digit(text[i - 1])
            and is_digit(text[i + 1])
        )
        if c in MARKS and not decimal:
            pieces.append("".join(now))
            now = []
        elif is_kept(c):
            now.append(c)
    pieces.append("".join(now))
    out = []
    for piece in pieces:
        out += re.split(r"\\r\\n|\\n|\\t|[0-9]{8,}", piece)
    return [p for p in out if p]


def ngrams(strings: list[str], n: int) -> Counter:
    out: Counter = Counter()
    for s, weight in Counter(strings).items():
        for i in range(len(s)):
            for k in range(1, min(n, len(s) - i) + 1):
                out[s[i : i + k]] += weight
    return out


def entropy(counts: list[int]) -> float:
    total = sum(counts)
    return sum(-c / total * math.log(c / total) for c in counts)


def freedoms(grams: Counter) -> dict[str, tuple[float, float]]:
    """word -> right and left freedom."""
    right, left = defaultdict(list), defaultdict(list)
    for g, f in grams.items():
        if len(g) > 1:
            right[g[:-1]].append(f)
            left[g[1:]].append(f)
    return {g: (entropy(right[g]), entropy(left[g])) for g in grams}


def cohesion(word: str, grams: Counter, total: int) -> float:
    return min(
        float(grams[word]) * total / grams[word[:k]] / grams[word[k:]]
        for k in range(1, len(word))
    )


def padded_freedom(texts: list[str], word: str) -> tuple[float, float]:
    """Right and left freedom with text ends as a neighbour."""
    right, left = Counter(), Counter()
    for t in texts:
        at = t.find(word)
        while at >= 0:
            end = at + len(word)
            right[t[end] if end < len(t) else ""] += 1
            left[t[at - 1] if at else ""] += 1
            at = t.find(word, at + 1)
    return entropy(list(right.values())), entropy(list(left.values()))
