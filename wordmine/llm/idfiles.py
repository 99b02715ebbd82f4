"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart.

The most frequent id of the corpus gets rank 0.  A rank takes one to four
bytes; two bits per rank, four to a control byte, say how many.  The control
bytes of a document stand together before its data bytes, so that numpy can
decode a document by looking its control bytes up in a table.

A data set is a folder with two Parquet tables, which Spark writes, commits and
retries on any file system.  ``ranks`` holds the id of every rank.  ``blocks``
holds one row per block of documents in ascending ``doc_id``:

``part, block``   place of the block: range of ids, number within the range
``first``         ids in earlier blocks of the same part
``doc_ids``       the documents; ``lengths``: their number of ids
``control, data`` the coded ranks of the documents, one after the other
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmine.llm.textbytes import text_bytes

#: Ids in a block, at least; a longer document is one block.
BLOCK_IDS = 1 << 20

BLOCKS = (
    "part int, block int, first long, n_ids long, doc_ids array<long>, "
    "lengths array<long>, control binary, data binary"
)

#: Bytes of the four ranks of every control byte.
WIDTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)])


# The code


def encode(ranks: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of documents whose ranks lie end to end."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = (ranks > 0xFF).astype(np.uint8)
    codes += ranks > 0xFFFF
    codes += ranks > 0xFFFFFF
    controls = (lengths + 3) // 4
    gap = np.cumsum(4 * controls) - 4 * controls - (np.cumsum(lengths) - lengths)
    spread = np.zeros(4 * int(controls.sum()), np.uint8)
    spread[np.arange(len(ranks)) + np.repeat(gap, lengths)] = codes
    control = spread.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    width = int(codes.max(initial=0)) + 1
    columns = ranks.view(np.uint8).reshape(-1, 4)[:, :width]
    data = columns[np.arange(width) <= codes[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The ranks again, end to end."""
    controls = (lengths + 3) // 4
    gap = np.cumsum(4 * controls) - 4 * controls - (np.cumsum(lengths) - lengths)
    total = int(lengths.sum())
    widths = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    widths = widths[np.arange(total) + np.repeat(gap, lengths)]
    starts = np.cumsum(widths) - widths
    stored = np.frombuffer(data, np.uint8)
    ranks = stored[starts].astype(np.uint32)
    for k in range(1, int(widths.max(initial=1))):
        longer = np.flatnonzero(widths > k)
        ranks[longer] |= stored[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


# Ranks


def _all_ids(column: pa.Array, dtype: str) -> np.ndarray:
    """The ids of all documents of a batch, end to end."""
    return np.frombuffer(text_bytes(column)[0], dtype)


def count_ids(tokens: DataFrame, dtype: str) -> DataFrame:
    """``id, n`` over all documents; each task sends one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 8 * np.dtype(dtype).itemsize if dtype == "<u2" else 0, np.int64)
        for batch in batches:
            own = np.bincount(_all_ids(batch.column("ids"), dtype), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts[ids])], names=["id", "n"]
        )

    counted = tokens.select("ids").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def rank_ids(counts: DataFrame) -> np.ndarray:
    """The id of every rank: by falling frequency, then by id.

    It has one entry per id in use, so it is bounded by the vocabulary.
    """
    rows = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return rows["id"].to_numpy(np.int64)


# Files


def _blocks(ids_by_rank: np.ndarray, dtype: str, block_ids: int):
    ranks = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    ranks[ids_by_rank] = np.arange(len(ids_by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, first, held, size = 0, 0, [], 0

        def row():
            lengths = np.concatenate([x for _, _, x in held]).astype(np.int64)
            ids = np.concatenate([x for _, x, _ in held])
            control, data = encode(ranks[ids], lengths)
            values = [[part], [block], [first], [len(ids)], [[d for x, _, _ in held for d in x]]]
            values += [[lengths.tolist()], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            names = "part block first n_ids doc_ids lengths control data".split()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            data, bounds = text_bytes(batch.column("ids"))
            values = np.frombuffer(data, dtype).copy()
            # A slice of the batch up to every row that completes a block.
            ends, start = bounds[1:] // values.itemsize, 0
            while start < len(docs):
                done = ends[start - 1] if start else 0
                stop = min(len(docs), int(np.searchsorted(ends, done + block_ids - size)) + 1)
                held.append((docs[start:stop], values[done : ends[stop - 1]], np.diff(ends[start:stop], prepend=done)))
                size += int(ends[stop - 1] - done)
                start = stop
                if size >= block_ids:
                    yield row()
                    block, first, held, size = block + 1, first + size, [], 0
        if held:
            yield row()

    return run


def write_ids(
    tokens: DataFrame, path: str, dtype: str = "<u2", block_ids: int = BLOCK_IDS
) -> None:
    """Write ``tokens`` (``doc_id, ids``) below ``path``, in ascending doc_id.

    ``tokens`` is read three times, so it should be a stored table.  The rows
    are range-partitioned by doc_id and sorted, then coded block by block.
    A null doc_id sorts first, equal ones by their ids.
    """
    spark = tokens.sparkSession
    ids_by_rank = rank_ids(count_ids(tokens, dtype))
    ranks = spark.createDataFrame(
        list(enumerate(ids_by_rank.tolist())), "rank long, id long"
    )
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(_blocks(ids_by_rank, dtype, block_ids), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (little-endian, four bytes each).

    ``start`` counts the ids of all documents before.  With ``digest`` the last
    column is ``ids_crc32`` instead.
    """
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()
    ids_by_rank = table["id"].to_numpy(np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row per part, and a part is a partition of the writer.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")
    )
    placed = blocks.join(F.broadcast(parts), F.col("part") == F.col("p"))
    placed = placed.select(
        (F.col("first") + F.col("skip")).alias("first"), "doc_ids", "lengths", "control", "data"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, docs, lengths, control, data = (c[k] for c in batch.columns)
                sizes = np.array(lengths.as_py(), np.int64)
                ids = ids_by_rank[decode(control.as_py(), data.as_py(), sizes)].astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = memoryview(ids.tobytes())
                own = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                if digest:
                    last = pa.array([zlib.crc32(x) for x in own], pa.int64())
                else:
                    last = pa.array([bytes(x) for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs.as_py(), pa.int64()),
                        pa.array(starts + first.as_py()),
                        pa.array(sizes),
                        last,
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids binary"
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
