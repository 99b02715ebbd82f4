"""What a Python worker remembers between tasks, one operator at a time.

Spark uses workers again for the stages of other operators, so whoever starts
work in a worker first lets go of what the others remembered there.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that are sent to a Python worker at once, at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_MEMORIES: list[dict] = []


def memory() -> dict:
    """A new dict that ``only`` can empty."""
    own: dict = {}
    _MEMORIES.append(own)
    return own


def only(kept: dict | None = None) -> None:
    """Empty all memories but ``kept``; what they held goes back to the system."""
    others = [m for m in _MEMORIES if m is not kept and m]
    for m in others:
        m.clear()
    if others:
        release()


def release() -> None:
    """Hand free memory of Python, Arrow and the allocator back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another allocator
        pass


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches, if they are higher.

    A batch is held by the executor and by the worker, and more than once while it
    is taken apart.  The limits stay lowered, since plans read them when they run.
    """
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    now = int(spark.conf.get(rows))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
