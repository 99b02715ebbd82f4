"""Best-fit packing of token pieces into sequences, by exact complements.

Documents are cut into pieces of at most ``size`` ids.  Only the number of
pieces of each length is brought to the driver (``size`` numbers at most).  The
plan is made on these counts: the longest length left opens a sequence, and the
gap beside it is looked up in an index of single lengths, of sums of two and of
sums of three lengths.  A combination that fills the gap exactly is taken as
often as the counts allow.  Where there is none, the best fit, the longest
length that still goes into the gap, is added and the rest of the gap is looked
up again.  Every entry of the plan uses up a length, or what is left of it to
less than the entry needs, so the plan stays small however many pieces there
are.  Pieces then find their place by their number within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmine.llm.tokens import REMEMBER, binaries, encode_batches

SIZE = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, path: str, size: int = SIZE, keep_ids: bool = False, added: bool = False, remember: int = REMEMBER
) -> DataFrame:
    """The pieces of every whole text: ``doc_id, piece, start, length, ids_crc32``.

    Only a document of more than ``size`` ids is cut; its last piece may be
    shorter.  A null text is empty and gives one piece, the end id.  With
    ``keep_ids`` the column ``ids`` (little-endian, four bytes each) follows.  ``added``
    reads added tokens in the texts as the library does by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, offsets in encode_batches(batches, path, added, remember):
            ids = ids.astype("<u4")
            sizes = np.diff(offsets)
            n = -(-sizes // size)
            owner = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(size, sizes[owner] - start)
            at = offsets[owner] + start
            raw = memoryview(ids.tobytes())
            crc = [
                zlib.crc32(raw[4 * a : 4 * (a + k)])
                for a, k in zip(at.tolist(), length.tolist(), strict=True)
            ]
            columns = [
                part.column("doc_id").take(pa.array(owner)),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(binaries(ids, np.append(at, len(ids))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    only = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return only.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


# The plan


class ComplementIndex:
    """Which lengths in stock add up to a sum: one, two or three of them.

    An entry is made when a sum is first asked for and checked against the
    counts when it is used; entries whose lengths have run out are made anew.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def _in_stock(self, lengths: tuple[int, ...], taken: Counter) -> bool:
        need = Counter(lengths)
        need.update(taken)
        return all(self.counts[x] >= k for x, k in need.items())

    def _pair(self, total: int, taken: Counter) -> tuple[int, ...] | None:
        found = self.pairs.get(total, ())
        if found is None:
            return None
        if found and self._in_stock(found, taken):
            return found
        have = self.counts[:total] > 0
        longer = np.flatnonzero(have[1:] & have[:0:-1]) + 1
        longer = longer[2 * longer >= total][::-1]
        if not len(longer):
            self.pairs[total] = None  # lengths are only used up, never added
            return None
        for x in longer.tolist():
            if self._in_stock((x, total - x), taken):
                self.pairs[total] = (x, total - x)
                return self.pairs[total]
        return None

    def find(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """Lengths that fill ``gap`` exactly, beside those already ``taken``."""
        if self._in_stock((gap,), taken):
            return (gap,)
        found = self._pair(gap, taken)
        if found:
            return found
        found = self.triples.get(gap, ())
        if found is None:
            return None
        if found and self._in_stock(found, taken):
            return found
        possible = False
        for x in np.flatnonzero(self.counts[:gap])[::-1].tolist():
            if 3 * x < gap:
                break
            rest = self._pair(gap - x, taken)
            possible |= self.pairs.get(gap - x, ()) is not None
            if rest and self._in_stock((x, *rest), taken):
                self.triples[gap] = (x, *rest)
                return self.triples[gap]
        if not possible:
            self.triples[gap] = None
        return None


def plan_sequences(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each."""
    stock = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        stock[length] = n
    index, plan = ComplementIndex(stock), []
    for length in range(size, 0, -1):
        while stock[length]:
            pattern, gap = (length,), size - length
            while gap:
                taken = Counter(pattern)
                found = index.find(gap, taken)
                if found:
                    pattern, gap = pattern + found, 0
                    break
                fits = np.flatnonzero(stock[: gap + 1])[::-1].tolist()
                best = next((x for x in fits if stock[x] > taken[x]), None)
                if best is None:
                    break
                pattern, gap = (*pattern, best), gap - best
            need = Counter(pattern)
            times = min(int(stock[x]) // k for x, k in need.items())
            for x, k in need.items():
                stock[x] -= k * times
            plan.append((pattern, times))
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows length, first number, first sequence, offset; ordered by the first two."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(pieces: DataFrame, size: int = SIZE, per_group: int = 1_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a column ``length``.

    ``pieces`` is read twice, so it should be a stored table.  Pieces of one
    length, however many, are numbered in groups of about ``per_group``, which
    are drawn by a hash of the piece.  Equal rows may change places.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = _slots(plan_sequences(counts, size))
    groups = max(1, -(-max(counts.values(), default=0) // per_group))
    keyed = pieces.withColumn(
        "_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    )
    held = keyed.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        F.col("length").alias("_l"),
        F.col("_g").alias("_h"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"),
    )
    within = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")
    numbered = keyed.withColumn("_r", F.row_number().over(within) - 1).join(
        held, (F.col("length") == F.col("_l")) & (F.col("_g") == F.col("_h"))
    )
    numbered = numbered.withColumn("_r", F.col("_r") + F.col("_skip"))
    numbered = numbered.select(*pieces.columns, F.col("_r").cast("long"))
    first = table[:, 0] * (1 << 44) + table[:, 1]
    names = list(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            number = np.asarray(batch.column("_r"))
            slot = table[np.searchsorted(first, length * (1 << 44) + number, "right") - 1]
            kept = [batch.column(c) for c in names]
            kept += [pa.array(slot[:, 2] + number - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays(kept, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in pieces.dtypes)
    return numbered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, n_pieces``: the packed ids; needs the column ``ids``.

    A group is one sequence, so it holds ``size`` ids at most.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.count("*").alias("n_pieces"))
