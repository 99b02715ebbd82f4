"""A Merkle manifest of a table, with a witness for every row.

Every row is a leaf.  The leaves of a group stand in order; eight neighbours at
a time become one node until one is left, the group's root.  The roots of the
groups become the root of the table in the same way.

Witnesses grow while leaves are appended (``Witnesses``): a new node takes the
digests of its open run as the left part of its witness, and each sibling that
comes later extends the right part.  A block of ``8 ** LEVELS`` neighbours is
appended in one task.  The roots of the blocks are appended in turn, a layer up,
until a group has one block; what a block's root gathers there continues the
witnesses of all rows of the block.  So the work of a task is bounded by the
size of a block, and the layers grow with the logarithm of the rows.

Defined cases: a null field is written ``-``, so it differs from an empty one.
Rows of equal ``doc_id`` (or of none, which come first) stand in order of their
leaves.  A group of one row has its leaf as root.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmine.llm.places import placed
from wordmine.session import materialize

#: Nodes of a run, as a power of two, and levels of a block.
RUN_BITS = 3
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Step = tuple[bytes, bytes]


def digest(*parts: bytes) -> bytes:
    """Lowercase hex of the SHA-256 of the parts end to end."""
    return sha256(b"".join(parts)).hexdigest().encode()


class Witnesses:
    """The open runs of a growing tree, and the witness of every node so far.

    Level 0 holds what is appended.  ``steps[level][i]`` is the left and right
    part of the witness of node ``i`` of a level, the digests of its siblings.
    """

    def __init__(self) -> None:
        self.steps: list[list[list[bytearray]]] = [[]]
        self.open: list[list[bytes]] = [[]]

    def append(self, node: bytes, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.steps.append([])
        run, steps = self.open[level], self.steps[level]
        for earlier in steps[len(steps) - len(run) :]:
            earlier[1] += node
        steps.append([bytearray(b"".join(run)), bytearray()])
        run.append(node)
        if len(run) == 1 << RUN_BITS:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.append(digest(*run), level + 1)

    def root(self, height: int | None) -> bytes:
        """Close what is open: up to ``height``, or until one node is left."""
        level = 0
        while level != height and (height is not None or len(self.steps[level]) > 1):
            if self.open[level]:
                self._close(level)
            level += 1
        self.height = level
        return self.open[level][0]

    def path(self, i: int) -> list[Step]:
        """The witness of leaf ``i`` below the root, from the bottom up."""
        return [tuple(map(bytes, self.steps[k][i >> RUN_BITS * k])) for k in range(self.height)]


def fold(node: bytes, path: list[Step]) -> bytes:
    """The root that a node and its witness lead to."""
    for left, right in path:
        node = digest(left, node, right)
    return node


def grown(nodes: list[bytes], n: int, levels: int) -> tuple[Witnesses, bytes]:
    """Witnesses of a block of a group of ``n`` nodes, and the block's root.

    A block among others is ``levels`` high even if few nodes are left for it.
    """
    witnesses = Witnesses()
    for node in nodes:
        witnesses.append(node)
    return witnesses, witnesses.root(levels if n > 1 << RUN_BITS * levels else None)


# Leaves


def _written(c: Column) -> Column:
    value = c.cast("string")
    sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    return F.coalesce(sized, F.lit("-"))


def leaf_of(**replaced: Column) -> Column:
    """The leaf of a row, hex; ``replaced`` stands in for columns of that name."""
    return F.sha2(F.concat(*[_written(replaced.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``g, doc_id, node, other``: the leaf, and the one that a tampered row would have.

    ``g`` stands for the language: empty for null, so that it sorts first.  Rows
    whose id's CRC-32 is divisible by three are tampered with: the letters A-Z of
    the text are lower-cased.  ``other`` is null for the rest.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    kinds = dict(zip(FIELDS, ("long", "string", "string", "long", "string"), strict=True))
    rows = docs.select(*[F.col(c).cast(kind) for c, kind in kinds.items()])
    return rows.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"),
        "doc_id",
        F.unhex(leaf_of()).alias("node"),
        F.when(tampered, F.unhex(leaf_of(text=lowered))).alias("other"),
    )


# Layers

_BLOCK = "g string, block long, n long, ids array<long>, nodes array<binary>, others array<binary>"


def layer(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks of a layer with their roots; ``nodes`` has ``g, pos, n, doc_id, node, other``."""

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for n, nodes in zip(batch["n"].to_pylist(), batch["nodes"], strict=True):
                hexed = [x.hex().encode() for x in nodes.as_py()]
                roots.append(bytes.fromhex(grown(hexed, n, levels)[1].decode()))
            yield batch.append_column("root", pa.array(roots, pa.binary()))

    item = F.struct("pos", F.col("doc_id").alias("id"), "node", "other")
    block = F.shiftright("pos", RUN_BITS * levels).alias("block")
    blocks = nodes.groupBy("g", block).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("i")
    )
    blocks = blocks.select("g", "block", "n", *[F.col(f"i.{c}").alias(f"{c}s") for c in ("id", "node", "other")])
    return materialize(blocks.mapInArrow(appended, f"{_BLOCK}, root binary"))


def layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """All layers from the given nodes up, until every group has one block."""
    found = [layer(nodes, levels)]
    size = 1 << RUN_BITS * levels
    while (found[-1].agg(F.max("n")).first()[0] or 0) > size:
        none = F.lit(None)
        roots = found[-1].select(
            "g",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / size).cast("long").alias("n"),
            none.cast("long").alias("doc_id"),
            F.col("root").alias("node"),
            none.cast("binary").alias("other"),
        )
        found.append(layer(roots, levels))
    return found


# Witnesses downwards

_STEP = pa.struct([("left", pa.binary()), ("right", pa.binary())])
_ABOVE = "path array<struct<left: binary, right: binary>>, subroot binary, top binary"


def _paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[dict, Witnesses, list[bytes], list[Step]]]:
    """For every block: its row, its witnesses, its nodes, and the path of its root."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch[c][k].as_py() for c in batch.schema.names}
            nodes = [x.hex().encode() for x in row["nodes"]]
            witnesses, _ = grown(nodes, row["n"], levels)
            above = [(s["left"], s["right"]) for s in row["path"]]
            yield row, witnesses, nodes, above


def extended(blocks: DataFrame, levels: int) -> DataFrame:
    """The path of every node of a layer, from blocks with the path of their root.

    ``block`` of the result is the node's place in its layer, so that of the block
    whose root it is, a layer below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, witnesses, nodes, above in _paths(batches, levels):
            size, first = len(nodes), row["block"] << RUN_BITS * levels
            paths = [
                [{"left": a, "right": b} for a, b in [*witnesses.path(i), *above]] for i in range(size)
            ]
            columns = [
                pa.array([row["g"]] * size),
                pa.array(range(first, first + size), pa.int64()),
                pa.array(row["nodes"], pa.binary()),
                pa.array(paths, pa.list_(_STEP)),
                pa.array([row["subroot"]] * size, pa.binary()),
                pa.array([row["top"]] * size, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names="g block node path subroot top".split())

    return blocks.mapInArrow(run, f"g string, block long, node binary, {_ABOVE}")


_RESULT = (
    "doc_id long, leaf string, subroot string, root string, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def verified(blocks: DataFrame, levels: int) -> DataFrame:
    """Proof and recomputed root of every leaf, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, witnesses, nodes, above in _paths(batches, levels):
            proofs, folded = [], []
            for i, (node, other) in enumerate(zip(nodes, row["others"], strict=True)):
                path = [*witnesses.path(i), *above]
                proofs.append(sha256(b"".join(x for step in path for x in step)).hexdigest())
                folded.append(fold(other.hex().encode() if other else node, path).decode())
            top, subroot = row["top"].hex(), row["subroot"].hex()
            columns = [
                pa.array(row["ids"], pa.int64()),
                pa.array([x.decode() for x in nodes]),
                pa.array([subroot] * len(nodes)),
                pa.array([top] * len(nodes)),
                pa.array(proofs),
                pa.array(folded),
                pa.array([x == top for x in folded]),
            ]
            names = [c.split()[0] for c in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, _RESULT)


def _down(found: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Blocks of the lowest layer with the path of their root; ``above`` has that of the groups."""
    for upper in reversed(found[1:]):
        above = extended(upper.join(above, ["g", "block"]), levels).drop("node")
    return found[0].join(above, ["g", "block"])


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; other columns are left
    alone.  ``proof_sha256`` is the hash of the digests of a row's witness, and
    ``folded_root`` what its leaf leads to after the tampering.  A task appends
    blocks of ``8 ** levels`` nodes.  Tables are stored at once.
    """
    # Stored, since dealing rows to ranges reads them twice.
    hashed = materialize(leaves(docs))
    below = layers(placed(hashed, ["g"], ["doc_id", "node"]), levels)
    none, root = F.lit(None), F.col("root")
    names = below[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), root.alias("node"))
    names = names.withColumns({"doc_id": none.cast("long"), "other": none.cast("binary")})
    names = materialize(placed(names, ["g"], ["name"]))
    langs = layers(names.drop("name"), levels)
    path = F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("path")
    top = langs[-1].select("g", "block", path, root.alias("subroot"), root.alias("top"))
    paths = extended(_down(langs, top, levels), levels)
    paths = paths.select(F.col("block").alias("pos"), "path", F.col("node").alias("subroot"), "top")
    groups = names.select(F.col("name").alias("g"), "pos").join(paths, "pos")
    above = groups.withColumn("block", F.lit(0).cast("long")).drop("pos")
    return verified(_down(below, above, levels), levels)
