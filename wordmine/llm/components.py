"""Connected components of a graph given as edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.session import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``a, b`` reaches.

    Every round, each node hands the smallest node it knows of to its larger
    neighbours, then to its smaller ones; long chains shrink to stars in a
    number of rounds that grows with the logarithm of their length.  No node's
    neighbours are gathered in one place: only smallest values are.  Rows move
    by equi-joins, which adaptive execution splits where one node has many.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = materialize(links.distinct())
    before = None
    for _ in range(most_rounds):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node to its smallest one.
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        low = low.select("n", F.least("n", "m").alias("m"))
        large = both.join(low, both["a"] == low["n"]).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node, to the smallest.
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["n"])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = low.select(F.col("n").alias("a"), F.col("m").alias("b"))
        links = materialize(small.unionAll(star).distinct())
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
