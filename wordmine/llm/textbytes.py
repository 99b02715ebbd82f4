"""Texts of an Arrow batch as bytes, and what numpy can do with them at once.

Every function takes the UTF-8 bytes of many texts laid end to end and the
offsets at which they start, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the n + 1 offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(texts: pa.Array, most: int = 2 << 20):
    """Cut a batch into slices of about ``most`` bytes, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.asarray(
        pc.fill_null(pc.binary_length(texts), 0), np.int64
    )
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text."""
    inside = ~IS_SPACE[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        inner = offsets[1:]
        after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_POWERS[0]) < n:
        size = -(-n // 65_536) * 65_536
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes.

    A polynomial of the bytes modulo 2**64: the difference of two prefix sums,
    shifted to the start of the span by a power of the inverse base.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers[: len(data)]
    np.cumsum(terms, out=sums[1:])
    spans = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(spans ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out * _BASE) ^ items[k : k + n]
        out = out ^ (out >> np.uint64(29))
    return mix(out)


def item_sums(items: np.ndarray) -> np.ndarray:
    """Prefix sums out of which ``sum_hashes`` takes the hash of any window."""
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * _powers(len(items) + 1)[0][: len(items)], out=sums[1:])
    return sums


def sum_hashes(sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` items from each start on, as in ``span_hashes``."""
    spans = (sums[starts + width] - sums[starts]) * _powers(len(sums))[1][starts]
    return mix(spans ^ (np.uint64(width) << np.uint64(48)))
