"""Windows of many texts counted in numpy, for use inside Spark tasks.

A window is packed into whole numbers, as narrow as the characters at hand allow,
and the windows of a slice of texts are sorted at once.  Equal ones are then
neighbours, and so are those with a common prefix, so that one sort serves the
n-grams of all sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose windows are sorted at once.
SLICE = 8_000_000
#: Rows of a batch that goes back to Spark.
ROWS = 100_000


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts end to end, and where each text begins."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if data.max() < 128:
        return data.astype(np.uint32), offsets
    try:
        whole = data.tobytes().decode()
    except UnicodeDecodeError:
        raw = texts.cast(pa.large_binary()).to_pylist()
        return points(pa.array([x.decode("utf-8", "replace") for x in raw], pa.large_string()))
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(whole.encode("utf-32-le"), "<u4"), before[offsets]


def _strings(chars: np.ndarray) -> pa.Array:
    """A string for each row of characters; zeros are left out."""
    if chars.dtype == np.uint8 and chars.all():
        offsets = np.arange(len(chars) + 1, dtype=np.int32) * np.int32(chars.shape[1])
        return pa.StringArray.from_buffers(len(chars), pa.py_buffer(offsets), pa.py_buffer(chars.tobytes()))
    used = chars != 0
    width = used.astype(np.int64)
    for limit in (0x80, 0x800, 0x10000) if chars.dtype != np.uint8 else ():
        width += chars >= limit
    offsets = np.concatenate(([0], np.cumsum(width.sum(1)))).astype(np.int32)
    flat = chars[used]
    if len(flat) and flat.max() >= 128:
        data = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    else:
        data = flat.astype(np.uint8).tobytes()
    return pa.StringArray.from_buffers(len(chars), pa.py_buffer(offsets), pa.py_buffer(data))


def window_counts(
    owner: np.ndarray,
    chars: np.ndarray,
    begins: np.ndarray,
    n: int,
    least: int,
    prefixes: bool,
    places: tuple[int, int],
) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``owner, word, n`` of the different windows of ``n`` characters of each owner.

    Text i is ``chars[begins[i]:begins[i + 1]]`` and belongs to ``owner[i]``.  At a
    text's end windows get shorter; those under ``least`` characters are left
    out.  With ``prefixes``, all prefixes of ``least`` to n characters are counted.
    Windows begin in the range ``places``.
    """
    lo, hi = places
    # Where j characters are left of a text, j < n.
    ends = [begins[1:][np.diff(begins) >= j] - j - lo for j in range(1, n)]
    ends = [e[(e >= 0) & (e < hi - lo)] for e in ends]
    enough = np.ones(hi - lo, bool)
    for e in ends[: least - 1]:
        enough[e] = False
    own = np.repeat(owner, np.diff(begins))[lo:hi][enough]
    if not len(own):
        return
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    alphabet = np.concatenate(([0], np.flatnonzero(seen)))
    alphabet = alphabet.astype(np.uint8 if alphabet[-1] < 128 else np.uint32)
    code = np.zeros(len(seen), np.uint32)
    code[alphabet[1:]] = np.arange(1, len(alphabet))
    code = np.concatenate((code[chars[lo : hi + n]], np.zeros(n, np.uint32)))

    def window(k: int) -> np.ndarray:
        out = code[k : k + hi - lo].copy()
        for e in ends[:k]:
            out[e] = 0
        return out

    bits = len(alphabet).bit_length()
    if int(owner.max()).bit_length() + n * bits <= 64:
        packed = np.repeat(owner, np.diff(begins))[lo:hi].astype(np.uint64)
        for k in range(n):
            packed <<= np.uint64(bits)
            packed |= window(k)
        packed = packed if least == 1 else packed[enough]
        packed.sort()
        mask = np.uint64((1 << bits) - 1)
        own_at = lambda at: packed[at] >> np.uint64(n * bits)
        char_at = lambda k, at: packed[at] >> np.uint64(bits * (n - 1 - k)) & mask
        # The highest bit in which neighbours differ tells where they part.
        apart = packed[1:] ^ packed[:-1]
        parts = lambda k: apart >= np.uint64(1 << bits * (n - k))
    else:
        columns = [window(k)[enough] for k in range(n)]
        order = np.lexsort((*reversed(columns), own))
        own, columns = own[order], [c[order] for c in columns]
        own_at = lambda at: own[at]
        char_at = lambda k, at: columns[k][at]
        apart = np.full(len(own) - 1, n)
        for k in reversed(range(n)):
            apart[columns[k][1:] != columns[k][:-1]] = k
        apart[own[1:] != own[:-1]] = -1
        parts = lambda k: apart < k
    for k in range(least if prefixes else n, n + 1):
        first = np.concatenate(([0], np.flatnonzero(parts(k)) + 1))
        count = np.diff(first, append=len(own))
        if prefixes:
            full = char_at(k - 1, first) != 0
            first, count = first[full], count[full]
        for x in range(0, len(first), ROWS):
            part = first[x : x + ROWS]
            chars_of = np.empty((len(part), k), alphabet.dtype)
            for j in range(k):
                chars_of[:, j] = alphabet[char_at(j, part)]
            yield own_at(part), _strings(chars_of), count[x : x + ROWS]


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def digests(words: pa.Array) -> np.ndarray:
    """The first 28 bits of the MD5 of each word.

    Words fit in one block of MD5, so its 64 steps are taken for all words at
    once; longer ones go to hashlib.
    """
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    size = np.diff(offsets)
    if not len(words):
        return np.zeros(0, np.int64)
    if size.max() > 55:
        raw = words.cast(pa.binary()).to_pylist()
        return np.array([int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[:4]) >> 4 for x in raw], np.int64)
    blocks = np.zeros((len(words), (int(size.max()) // 4 + 1) * 4), np.uint8)
    if size.max():
        blocks[np.arange(blocks.shape[1]) < size[:, None]] = np.frombuffer(words.buffers()[2], np.uint8)[
            offsets[0] : offsets[-1]
        ]
    blocks[np.arange(len(words)), size] = 0x80
    message = dict(enumerate(np.ascontiguousarray(blocks.view("<u4").T)))
    message[14] = size.astype(np.uint32) * np.uint32(8)
    a, b, c, d = (np.full(len(words), x) for x in _START)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        mixed = _mix(turn, b, c, d)
        mixed += a
        mixed += _SINES[i]
        if at in message:
            mixed += message[at]
        by = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(by)) | (mixed >> np.uint32(32 - by)))
    return ((a + _START[0]).byteswap() >> np.uint32(4)).astype(np.int64)


def _mix(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about SLICE bytes in the last column, or one row."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            yield batch.slice(start, stop - start)
            start = stop


def _owners(keys: pa.Array) -> np.ndarray:
    """Numbers the runs of equal keys, from 0."""
    coded = keys.dictionary_encode("encode").indices.to_numpy()
    return np.cumsum(np.concatenate(([0], coded[1:] != coded[:-1])))


def counting(n: int, least: int, prefixes: bool, digest: bool = False):
    """For mapInArrow over ``text``, or over ``key, text`` with the rows of a key together.

    Returns ``key, word, n, whole``, and ``digest`` if asked for.  Where ``whole``,
    no other row has the same key and word; the windows of a key with more than
    a slice of text come in several rows.  Without keys: ``word, n``, counts of a slice.
    """

    def windows(table: pa.Table, open_key, carried: bool) -> Iterator[pa.RecordBatch]:
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column(table.num_columns - 1).chunks])
        chars, begins = points(texts)
        keyed = table.num_columns > 1
        keys = pa.concat_arrays(table.column(0).chunks) if keyed else None
        owner = _owners(keys) if keyed else np.zeros(len(texts), np.int64)
        first = np.searchsorted(owner, np.arange(owner[-1] + 1))
        whole = np.full(len(first), keyed and len(chars) <= 2 * SLICE)
        whole[0] &= not carried
        if open_key:
            whole[-1] = False
        for lo in range(0, len(chars), 2 * SLICE):
            places = (lo, min(lo + 2 * SLICE, len(chars)))
            for own, words, count in window_counts(owner, chars, begins, n, least, prefixes, places):
                own = own.astype(np.int64)
                columns = [words, pa.array(count.astype(np.int64))]
                names = ["word", "n"]
                if keyed:
                    columns = [keys.take(pa.array(first[own])), *columns, pa.array(whole[own])]
                    names = ["key", *names, "whole"]
                if digest:
                    columns, names = [*columns, pa.array(digests(words))], [*names, "digest"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, carried = [], 0, None
        for part in _sliced(batches):
            held.append(part)
            size += part.column(part.num_columns - 1).nbytes
            if size < SLICE:
                continue
            table = pa.Table.from_batches(held)
            rest = 0
            if table.num_columns > 1:
                # The last key may go on; it waits, unless there is no other.
                owner = _owners(pa.concat_arrays(table.column(0).chunks))
                rest = int((owner == owner[-1]).sum()) if owner[-1] else 0
            now = table.slice(0, len(table) - rest)
            key = now.column(0)[-1].as_py() if table.num_columns > 1 else None
            goes_on = carried is not None and carried == [now.column(0)[0].as_py()]
            yield from windows(now, not rest, goes_on)
            carried = None if rest or table.num_columns == 1 else [key]
            held = table.slice(len(table) - rest).to_batches() if rest else []
            size = sum(x.column(x.num_columns - 1).nbytes for x in held)
        if held:
            table = pa.Table.from_batches(held)
            yield from windows(table, False, carried is not None and carried == [table.column(0)[0].as_py()])

    return run
