"""The prefix trie of conversations that share their first turns.

A conversation is rebuilt: its first turns are those of the first one of its
twenty, the rest its own.  Each distinct sequence of first turns is a node; the
conversations that start with it are its members.  The sums over subtrees come
from ``forest.subtree_sums``.

A sequence is told by its length and four sums of 32 bits, over its turns, of a
hash of the turn's place and contents; so keys of all prefixes are running sums,
which a conversation of any length gets from ranges of its turns.

Defined cases: rows without a ``conv_id`` belong to no conversation and are left
out.  A null role or text is empty.  Turns of the same number (or of none, which
come first) stand in order of the SHA-256 of role and text.  Conversations without
any turn left are members of the root alone.  An empty table has no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm.forest import subtree_sums
from wordmine.llm.places import placed
from wordmine.session import materialize, running_sums

#: Conversations that share a beginning, and the most turns that are shared, plus one.
FAMILY = 20
SHARED = 4
#: Member ids that are joined to one text, at most.
CHUNK = 4096

_SUMS = ["s0", "s1", "s2", "s3"]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``n`` (turns), ``mark`` (SHA-256 of role and text), ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        mark.alias("mark"),
        words.cast("long").alias("words"),
    )
    return placed(materialize(rows), ["conv_id"], ["turn", "mark"]).drop("turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (``conv_id, size``) and their turns (``conv_id, d, mark, words``)."""
    rows = materialize(rows)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = rows.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("h", h)
    convs = convs.withColumn("leader", F.col("conv_id") - F.col("conv_id") % FAMILY)
    firsts = convs.select(F.col("conv_id").alias("leader"), F.col("n").alias("led"))
    taken = F.least("h", F.coalesce("led", F.lit(0)))
    convs = convs.join(firsts, "leader", "left").withColumn("taken", taken)
    size = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = materialize(convs.select("conv_id", "leader", "h", "taken", size.alias("size")))
    heads = rows.where((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.select(F.col("conv_id").alias("leader"), "pos", "mark", "words")
    shared = convs.join(heads, "leader").where("pos < h")
    shared = shared.select("conv_id", (F.col("pos") + 1).alias("d"), "mark", "words")
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "mark", "words")
    return convs.select("conv_id", "size"), shared.unionAll(own)


def prefixes(steps: DataFrame) -> DataFrame:
    """Add ``key`` and ``up``: what tells the first d and the first d - 1 turns."""
    hashes = [F.xxhash64(F.lit(k), "d", "mark") for k in (0, 1)]
    low = F.lit((1 << 32) - 1)
    halves = [x for h in hashes for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    steps = steps.select("*", *[x.alias(c) for c, x in zip(_SUMS, halves, strict=True)])
    summed = running_sums(steps, ["conv_id"], ["d"], _SUMS)
    after = [F.hex(f"{c}_upto") for c in _SUMS]
    before = [F.hex(F.col(f"{c}_upto") - F.col(c)) for c in _SUMS]
    return summed.select(
        "conv_id",
        "d",
        "words",
        F.concat_ws(".", "d", *after).alias("key"),
        F.concat_ws(".", F.col("d") - 1, *before).alias("up"),
    )


_ROOT = "0.0.0.0.0"


def _flushed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the same key joined to texts; rows come in order of key and id."""
    names = ["key", "first", "ids"]
    key, ids, out = None, [], []
    for batch in batches:
        for k, c in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        if out:
            yield _flushed(out, names)
            out = []
    if ids:
        yield _flushed([(key, ids[0], ",".join(map(str, ids)))], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its chunks, which come in order."""
    names = ["key", "ends_sha256"]
    key, state, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, sha256()
            state.update(ids.encode())
        if out:
            yield _flushed(out, names)
            out = []
    if state is not None:
        yield _flushed([(key, state.hexdigest())], names)


def ends(last: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the sorted ``conv_id`` of every key, comma-joined.

    The ids are sorted and joined in ranges, so that of a key with very many only
    chunks of text, read one at a time, come to the task that hashes them.
    """
    order = ["key", "conv_id"]
    ranged = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ranged.mapInArrow(_chunks, "key string, first long, ids string")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "first")
    return chunks.mapInArrow(_hashed, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (``conv_id, turn, role, text``).

    ``conv_id`` is the smallest member, ``depth`` the number of turns;
    ``parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` as
    for the node and, of leaves and saved words, its subtree.  Tables are stored at
    once.
    """
    convs, steps = rebuilt(turns(conversations))
    paths = materialize(prefixes(steps))
    whole = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))
    root = whole.where("n_convs > 0").select(
        F.lit(_ROOT).alias("key"),
        F.lit(None).cast("string").alias("up"),
        F.lit(0).cast("long").alias("depth"),
        "owner",
        "n_convs",
        F.lit(0).cast("long").alias("words"),
    )
    nodes = paths.groupBy("key").agg(
        F.min("up").alias("up"),
        F.min("d").alias("depth"),
        F.min("conv_id").alias("owner"),
        F.count("*").alias("n_convs"),
        F.min("words").alias("words"),
    )
    nodes = materialize(nodes.unionAll(root.select(*nodes.columns)))
    owners = nodes.select(F.col("key").alias("up"), F.col("owner").alias("parent_conv_id"))
    born = nodes.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(owners, "up", "left").join(born, "key", "left")
    # Of the members of a node, the smallest and the depth tell it from all others.
    name = lambda c, d: F.concat(F.col(c).cast("string"), F.lit("."), d.cast("string"))
    nodes = materialize(
        nodes.withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0)),
                "node": name("owner", F.col("depth")),
                "parent": name("parent_conv_id", F.col("depth") - 1),
            }
        )
    )
    values = {
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }
    forest = nodes.select("node", "parent", *[v.alias(c) for c, v in values.items()])
    sums = subtree_sums(forest, list(values))
    last = paths.join(convs, "conv_id").where("d = size").select("key", "conv_id")
    none = convs.where("size = 0").select(F.lit(_ROOT).alias("key"), "conv_id")
    ended = ends(last.unionAll(none))
    empty = F.lit(sha256(b"").hexdigest())
    found = nodes.join(sums, "node").join(ended, "key", "left")
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
