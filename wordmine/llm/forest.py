"""Sums over all subtrees of a forest, by centroid decomposition.

A forest is a table of nodes with their parents.  It is cut into connected parts
that hold fewer than ``bound`` nodes each: an edge stays inside a part if both ends
have the same ``size div bound``, where ``size`` counts the nodes of a subtree.
With the quotient 0 a part is a whole subtree, with any other it is a path, since
two children of the same quotient would make their parent's at least twice as
large.  There are few paths, one or two per ``bound`` nodes.

Totals of parts that are whole subtrees go to the nodes they hang from.  The paths,
each taken as one node, make a smaller forest, which is summed up in the same way;
its totals go to the nodes they hang from, too.  What is left is one part per task
at a time: ``rolled_up`` splits it at its centroid into components of at most half
the nodes, adds the total below the centroid along the path to the component's
top, and goes on with the components.  So neither a chain nor a star of any size
comes together in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.session import materialize

#: Nodes of a part, at most.
BOUND = 512
#: Rounds of pointer jumping: enough for paths of 2 ** 40 nodes.
MOST_ROUNDS = 40


def rolled_up(parents: Sequence[int], values: Sequence[Sequence[int]]) -> list[list[int]]:
    """Subtree sums of every column of ``values``; ``parents`` are indices, -1 for a root."""
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    order = []
    for v, p in enumerate(parents):
        (children[p] if p >= 0 else order).append(v)
    roots = list(order)
    for v in order:
        order.extend(children[v])
    totals = [[0] * n for _ in values]
    size, part = [0] * n, [0] * n
    for k, root in enumerate(roots):
        part[root] = k
    for v in order:
        if parents[v] >= 0:
            part[v] = part[parents[v]]
    trees: list[list[int]] = [[] for _ in roots]
    for v in order:
        trees[part[v]].append(v)
    # Components with parents before children; the first node is the top.
    todo = trees
    while todo:
        nodes = todo.pop()
        top = nodes[0]
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes[1:]):
            size[parents[v]] += size[v]
        # Nodes with half the component below them are the path from the top to the centroid.
        centroid = [v for v in nodes if 2 * size[v] >= len(nodes)][-1]
        below: dict[int, list[int]] = {}
        upper = []
        part[centroid] = centroid
        inside = {centroid}
        for v in nodes:
            p = parents[v]
            if v == centroid:
                continue
            if v != top and p in inside:
                part[v] = v if p == centroid else part[p]
                inside.add(v)
                below.setdefault(part[v], []).append(v)
            else:
                upper.append(v)
        for column, total in zip(values, totals, strict=True):
            sums = sum(column[v] for v in inside)
            v = centroid
            while True:
                total[v] += sums
                if v == top:
                    break
                v = parents[v]
        todo += [x for x in (upper, *below.values()) if x]
    return totals


def subtree_sizes(forest: DataFrame) -> DataFrame:
    """``node, size``: the number of nodes of every subtree, by pointer jumping.

    Every round doubles the distance that counts have come, so the rounds are the
    logarithm of the height.  A table is stored per round.
    """
    table = materialize(forest.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    for _ in range(MOST_ROUNDS):
        if table.where("up is not null").isEmpty():
            return table.select("node", "size")
        sent = table.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        ups = table.select(F.col("node").alias("up"), F.col("up").alias("next"))
        table = materialize(
            table.join(sent, "node", "left")
            .join(ups, "up", "left")
            .select("node", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )
    raise ValueError("the parents form a cycle")


def parts(forest: DataFrame, bound: int) -> DataFrame:
    """Add ``low`` (whole subtree or path) and ``top``, the top node of a node's part."""
    sizes = subtree_sizes(forest).select("node", F.floor(F.col("size") / bound).alias("q"))
    ups = sizes.select(F.col("node").alias("parent"), F.col("q").alias("up_q"))
    forest = forest.join(sizes, "node").join(ups, "parent", "left")
    inner = F.coalesce(F.col("q") == F.col("up_q"), F.lit(False))
    forest = materialize(
        forest.withColumns({"low": F.col("q") == 0, "top": F.when(inner, F.col("parent")).otherwise(F.col("node"))}).drop(
            "q", "up_q"
        )
    )
    jumps = forest.select("node", "top")
    for _ in range(MOST_ROUNDS):
        ahead = jumps.select(F.col("node").alias("top"), F.col("top").alias("next"))
        moved = materialize(jumps.join(ahead, "top").select("node", "next", (F.col("next") != F.col("top")).alias("m")))
        jumps = moved.select("node", F.col("next").alias("top"))
        if moved.where("m").isEmpty():
            break
    return forest.drop("top").join(jumps, "node")


def _in_parts(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(table: pa.Table) -> pa.RecordBatch:
            nodes, tops = table["node"].to_pylist(), table["top"].to_pylist()
            at = {v: i for i, v in enumerate(nodes)}
            above = zip(nodes, table["parent"].to_pylist(), tops, strict=True)
            parents = [-1 if v == top else at[p] for v, p, top in above]
            totals = rolled_up(parents, [table[c].to_pylist() for c in names])
            columns = [pa.array(nodes, table["node"].type), *[pa.array(t, pa.int64()) for t in totals]]
            return pa.RecordBatch.from_arrays(columns, names=["node", *names])

        # Rows come in order of their part; the last part of a batch may go on.
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            tops = held["top"].to_pylist()
            cut = len(tops)
            while cut and tops[cut - 1] == tops[-1]:
                cut -= 1
            if cut:
                yield summed(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield summed(held)

    return run


def _hung(table: DataFrame, totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the totals of parts (``parent`` and ``names``) to the nodes they hang from."""
    more = totals.groupBy(F.col("parent").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in names])
    both = table.join(more, "node", "left")
    return both.select(
        *[F.col(c) for c in table.columns if c not in names],
        *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names],
    )


def subtree_sums(forest: DataFrame, names: Sequence[str], bound: int = BOUND) -> DataFrame:
    """``node`` and, under ``names``, the sum of each of these columns over its subtree.

    ``forest`` has one row per ``node``, its ``parent`` (null for a root, otherwise
    a node of the table) and whole numbers under ``names``, none null.  Tables are
    stored at once.  An empty forest gives an empty table.
    """
    names = list(names)
    table = materialize(parts(forest.select("node", "parent", *names), bound))
    sums = [F.sum(c).alias(c) for c in names]
    hanging = F.max(F.when(F.col("node") == F.col("top"), F.col("parent"))).alias("parent")
    lows = table.where("low").groupBy("top").agg(hanging, *sums).where("parent is not null")
    paths = table.where("not low")
    if not paths.isEmpty():
        paths = materialize(_hung(paths, lows, names))
        short = paths.groupBy("top").agg(hanging, *sums)
        homes = paths.select(F.col("node").alias("parent"), F.col("top").alias("home"))
        short = materialize(short.join(homes, "parent", "left"))
        shrunk = short.select(F.col("top").alias("node"), F.col("home").alias("parent"), *names)
        found = subtree_sums(shrunk, names, bound).withColumnRenamed("node", "top")
        whole = short.select("top", "parent").join(found, "top").where("parent is not null")
        paths = _hung(paths, whole, names)
    ready = table.where("low").select(*paths.columns).unionAll(paths)
    rows = ready.select("node", "parent", "top", *names).repartition("top").sortWithinPartitions("top")
    kind = dict(rows.dtypes)["node"]
    schema = ", ".join([f"node {kind}", *[f"`{c}` long" for c in names]])
    return rows.mapInArrow(_in_parts(names), schema)
