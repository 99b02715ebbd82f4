"""Rules learnt from labelled words: a tree of exact splits, grown level by level.

Every distinct value of every feature is tried as a limit.  A feature's limit is
the one with the largest gain in entropy; a node takes the feature with the
largest gain ratio among those whose gain is not below the average, as C4.5 does.
All counts come from aggregates over the labelled words, so the tree does not
depend on how they are laid out.  Only the limits of a level, at most two to its
power, reach the driver.

A grown tree can be pruned from the bottom up: a node becomes a leaf where the
errors to be expected of it as a leaf are no more than those of its leaves.  What
is expected is the upper end of a confidence interval for the share of errors.

Learnt rules are a table of at most two rows per leaf (``rules_table``), which
``write_rules`` stores and ``read_rules`` reads, for a job to use another day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.operators.association import association
from wordmine.session import materialize, running_sums

#: The five measures stand beside frequency, freedom and cohesion.
FEATURES = ("freq", "freedom", "cohesion", "dice", "mi", "scp", "zscore", "tscore")
#: Gains and ratios are rounded to this many digits, so that ties are ties.
DIGITS = 9


@dataclass
class Rules:
    """Limits of inner nodes and predictions of leaves.

    Node 1 is the root; the children of n are 2n, for values up to the limit,
    and 2n + 1, for larger and missing ones.
    """

    cols: Sequence[str]
    limits: dict[int, tuple[str, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, inner, leaf, node: int = 1):
        if node not in self.limits:
            return leaf(node)
        name, limit = self.limits[node]
        low, high = (self.walk(inner, leaf, 2 * node + k) for k in (0, 1))
        return inner(name, limit, low, high)

    def node(self) -> Column:
        """The leaf that a row falls into."""
        choose = lambda name, limit, low, high: F.when(F.col(name) <= limit, low).otherwise(high)
        return self.walk(choose, lambda n: F.lit(n))

    def text(self) -> str:
        """The rules as nested if/else text."""

        def inner(name, limit, low, high):
            shift = lambda t: "\n".join("  " + x for x in t.split("\n"))
            return f"If {name} <= {limit!r}\n{shift(low)}\nElse\n{shift(high)}"

        return self.walk(inner, lambda n: f"Predict {self.leaves.get(n, 0.0)}")


def _plogp(part: Column, whole: Column) -> Column:
    return F.when(part > 0, -part / whole * F.ln(part / whole)).otherwise(0.0)


def _entropy(pos: Column, neg: Column) -> Column:
    return _plogp(pos, pos + neg) + _plogp(neg, pos + neg)


def best_splits(rows: DataFrame, cols: Sequence[str], weight: float = 1.0, min_leaf: int = 1) -> DataFrame:
    """``node, feature, value, gain, ratio``: the best limit of each node, if any gains.

    ``rows`` holds ``node``, ``label`` and ``cols``; a positive row counts
    ``weight``.  Both sides keep ``min_leaf`` rows.  Stores tables at once.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value"))
            for i, c in enumerate(cols)
        ]
    )
    long = rows.select("node", "label", F.inline(pairs)).where("value is not null")
    counts = long.groupBy("node", "feature", "value").agg(
        F.count("*").alias("n"), F.sum("label").alias("pos")
    )
    upto = running_sums(counts, ["node", "feature"], ["value"], ["n", "pos"])
    # One row per node of the level.
    whole = rows.groupBy("node").agg(F.count("*").alias("all_n"), F.sum("label").alias("all_pos"))
    tried = upto.join(F.broadcast(whole), "node").where(
        (F.col("n_upto") >= min_leaf) & (F.col("all_n") - F.col("n_upto") >= min_leaf)
    )
    w = F.lit(float(weight))
    pos, neg = F.col("pos_upto") * w, (F.col("n_upto") - F.col("pos_upto")).cast("double")
    all_pos, all_neg = F.col("all_pos") * w, (F.col("all_n") - F.col("all_pos")).cast("double")
    left, total = pos + neg, all_pos + all_neg
    right = total - left
    inside = left / total * _entropy(pos, neg) + right / total * _entropy(all_pos - pos, all_neg - neg)
    gain = F.round(_entropy(all_pos, all_neg) - inside, DIGITS)
    tried = tried.select("node", "feature", "value", gain.alias("gain"), _entropy(left, right).alias("info"))
    tried = tried.withColumn("ratio", F.round(F.col("gain") / F.col("info"), DIGITS))
    # Largest gain, then smallest value.
    best = F.max(F.struct("gain", (-F.col("value")).alias("low"), "ratio")).alias("b")
    features = tried.groupBy("node", "feature").agg(best).select("node", "feature", "b.*")
    mean = features.groupBy("node").agg(F.avg("gain").alias("mean"))
    able = features.join(F.broadcast(mean), "node").where("gain > 0 and gain + 1e-9 >= mean")
    # Largest ratio, then first feature.
    chosen = F.max(F.struct("ratio", (-F.col("feature")).alias("first"), "low", "gain")).alias("b")
    return able.groupBy("node").agg(chosen).select(
        "node",
        (-F.col("b.first")).alias("feature"),
        (-F.col("b.low")).alias("value"),
        F.col("b.gain").alias("gain"),
        F.col("b.ratio").alias("ratio"),
    )


def expected_errors(pos: float, neg: float, z: float) -> float:
    """Errors of a leaf, by the upper end of the Wilson interval of their share.

    ``z`` is the normal quantile of the confidence.  An empty leaf errs nowhere.
    """
    n = pos + neg
    if n <= 0:
        return 0.0
    f, zz = min(pos, neg) / n, z * z
    return n * (f + zz / (2 * n) + z * sqrt(f / n - f * f / n + zz / (4 * n * n))) / (1 + zz / n)


def pruned(rules: Rules, counts: Mapping[int, tuple[float, float]], confidence: float) -> Rules:
    """The rules without the splits that do not pay.

    ``counts`` holds what a leaf weighs, positive and negative.  The smaller
    ``confidence`` is, the wider the interval and the more goes; 0.25 is usual.
    The decision is made on errors rounded to ``DIGITS``.
    """
    z = NormalDist().inv_cdf(1 - confidence)
    out = Rules(rules.cols)

    def leaf(node: int, pos: float, neg: float) -> None:
        out.leaves[node] = float(pos > neg)

    def walk(node: int) -> tuple[float, float, float]:
        """Weights below a node, and the errors expected after pruning."""
        if node not in rules.limits:
            pos, neg = counts.get(node, (0.0, 0.0))
            leaf(node, pos, neg)
            return pos, neg, expected_errors(pos, neg, z)
        (p, n, a), (q, m, b) = (walk(2 * node + k) for k in (0, 1))
        pos, neg = p + q, n + m
        whole = expected_errors(pos, neg, z)
        if round(whole, DIGITS) <= round(a + b, DIGITS):
            for k in [k for d in (out.limits, out.leaves) for k in d if _below(k, node)]:
                out.limits.pop(k, None)
                out.leaves.pop(k, None)
            leaf(node, pos, neg)
            return pos, neg, whole
        out.limits[node] = rules.limits[node]
        return pos, neg, a + b

    walk(1)
    return out


def _below(node: int, top: int) -> bool:
    return node > top and node >> (node.bit_length() - top.bit_length()) == top


def learn_rules(
    features: DataFrame,
    labels: DataFrame,
    cols: Sequence[str] = ("freq", "freedom", "cohesion"),
    max_depth: int = 5,
    min_leaf: int = 1,
    balance: bool = False,
    prune: float | None = None,
) -> Rules:
    """Grow a tree on the words that carry a label (``word, label``, 1 for a word).

    With ``balance`` both labels weigh the same however rare one is.  ``prune`` is
    the confidence of ``pruned``; without it nothing is pruned.  All labelled words
    are used; tables are stored at once.
    """
    known = materialize(features.join(labels, "word").select("label", *cols))
    sizes = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    negative, positive = sizes["n"] - sizes["pos"], sizes["pos"]
    weight = negative / positive if balance and positive and negative else 1.0
    rules, open_nodes = Rules(tuple(cols)), {1}
    for _ in range(max_depth):
        rows = known.withColumn("node", rules.node()).where(F.col("node").isin(sorted(open_nodes)))
        found = best_splits(rows, cols, weight, min_leaf).collect()
        open_nodes = set()
        for r in found:
            rules.limits[r["node"]] = (cols[r["feature"]], r["value"])
            open_nodes |= {2 * r["node"], 2 * r["node"] + 1}
        if not open_nodes:
            break
    held = known.groupBy(rules.node().alias("node")).agg(
        F.count("*").alias("n"), F.sum("label").alias("pos")
    )
    counts = {r["node"]: (r["pos"] * weight, float(r["n"] - r["pos"])) for r in held.collect()}
    rules.leaves = {node: float(pos > neg) for node, (pos, neg) in counts.items()}
    return rules if prune is None else pruned(rules, counts, prune)


def apply_rules(rules: Rules, features: DataFrame) -> DataFrame:
    """Add ``prediction`` (1.0 for a word) to candidates with features."""
    choose = lambda name, limit, low, high: F.when(F.col(name) <= limit, low).otherwise(high)
    decided = rules.walk(choose, lambda n: F.lit(rules.leaves.get(n, 0.0)))
    return features.select(*features.columns, decided.alias("prediction"))


def rule_features(
    words: DataFrame, frequent: DataFrame, total: Column, cols: Sequence[str] = FEATURES
) -> DataFrame:
    """``word`` and ``cols`` of words that have ``freq, freedom, cohesion``.

    Doubles are rounded to six digits and ``scp``, a ratio of high powers, is taken
    as its logarithm.  So a limit learnt from one run means the same in another.
    """
    table = words.select("word", *FEATURES[:3])
    if not set(cols) <= set(table.columns):
        table = association(table, frequent, total).withColumn("scp", F.ln("scp"))
    kinds = dict(table.dtypes)
    return table.select(
        "word", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols]
    )


def select_learnt(table: DataFrame, measured: DataFrame, rules: Rules) -> DataFrame:
    """The rows of ``table`` whose word the rules accept; ``measured`` has ``rule_features``."""
    accepted = apply_rules(rules, measured).where("prediction = 1")
    return table.join(accepted.select("word"), "word", "left_semi")


# Stored rules

_SCHEMA = "node bigint, feature string, value double, prediction double, cols array<string>"


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """One row per node: the feature and value of a split, or the prediction of a leaf."""
    cols = list(rules.cols)
    splits = [(n, c, v, None, cols) for n, (c, v) in rules.limits.items()]
    predicted = rules.leaves if splits or rules.leaves else {1: 0.0}
    leaves = [(n, None, None, p, cols) for n, p in predicted.items()]
    return spark.createDataFrame(sorted(splits + leaves), _SCHEMA)


def write_rules(spark: SparkSession, rules: Rules, path: str) -> None:
    """Store rules as a Parquet table; an existing path is refused."""
    rules_table(spark, rules).coalesce(1).write.mode("error").parquet(path)


def read_rules(spark: SparkSession, path: str) -> Rules:
    """The rules again: the same as were written, to the last bit of every limit.

    A table without a root, or with a node that hangs from no split, is refused.
    """
    rows = spark.read.schema(_SCHEMA).parquet(path).collect()
    rules = Rules(tuple(rows[0]["cols"]) if rows else ())
    for r in rows:
        if r["feature"] is not None:
            rules.limits[r["node"]] = (r["feature"], r["value"])
        else:
            rules.leaves[r["node"]] = r["prediction"]
    known = rules.limits.keys() | rules.leaves.keys()
    # A leaf that no labelled word fell into predicts 0 and need not be listed.
    if not known or any(n > 1 and n // 2 not in rules.limits for n in known):
        raise ValueError(f"no tree of rules at {path}")
    return rules
