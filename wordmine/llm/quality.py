"""Graded quality of whole texts by an ordinal cumulative-link regression.

Every word of a text, and its shape, is hashed to one of ``BUCKETS`` weights,
which all grades share.  The score of a text is the sum of its weights over the
root of their number.  Ordered thresholds t_1 < t_2 ... turn it into
P(grade <= k) = sigmoid(t_k - score), from which come the expected grade and the
probability of the top grade, by which texts are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm.textbytes import LOWER, runs, span_hashes, text_bytes, words

BUCKETS = 1 << 18
#: Of these, the first few are for shapes and repetitions.
SHAPES = 256
#: Rated texts, about, that the weights are fitted on.
SAMPLE_TEXTS = 9_000
#: Of these, how many must hold a bucket that gets a weight.
LEAST_TEXTS = 10
#: Grades weigh as their number in the table to this power: 0 is the same, 1 as found.
PRIOR_POWER = 0.8
#: Least probability of the top grade for a text to be kept.
LEAST_TAIL = 0.5

#: Bytes: small letter or beyond ASCII, capital, digit, other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[128:] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CORE = _CLASS < 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts end to end, two per word, and their offsets.

    A word counts without its marks at both ends, in small letters.  Its shape
    says whether it holds small letters, capitals beyond the first, digits, and
    up to two marks, and whether it is the word before, or the last but one to
    four, again.
    """
    data, offsets = text_bytes(texts)
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), 2 * first
    place = np.arange(len(data))
    core = _CORE[data]
    left = np.minimum.accumulate(np.where(core, place, len(data))[::-1])[::-1][starts]
    right = np.maximum.accumulate(np.where(core, place, -1))[ends - 1] + 1
    bare = left >= ends
    left, right = np.where(bare, starts, left), np.where(bare, ends, right)
    word = span_hashes(LOWER[data], left, right)
    shape = np.zeros(len(starts), np.int64)
    for k in range(4):
        seen = np.concatenate(([0], np.cumsum(_CLASS[data] == k)))
        n = seen[ends] - seen[starts]
        if k == 1:
            n = n - (_CLASS[data[starts]] == 1)
        shape = shape * 3 + np.minimum(n, 2) if k == 3 else shape * 2 + np.minimum(n, 1)
    again = np.zeros(len(starts), np.int64)
    number = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
    for back in (4, 3, 2, 1):
        same = word[back:] == word[:-back]
        again[back:][same & (number[back:] >= back)] = 1 if back > 1 else 2
    shape = shape * 3 + again
    both = np.empty(2 * len(starts), np.int64)
    both[0::2] = (word % np.uint64(BUCKETS - SHAPES)).astype(np.int64) + SHAPES
    both[1::2] = shape
    return both, 2 * first


@dataclass
class Ordinal:
    """Shared weights, ordered thresholds, the grades they stand between."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def scores(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            sums = np.add.reduceat(self.weights[buckets], offsets[full])
            out[full] = sums / np.sqrt(offsets[full + 1] - offsets[full])
        return out

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """One column per grade."""
        below = _sigmoid(self.thresholds[None, :] - scores[:, None])
        below = np.concatenate((np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))), 1)
        return np.diff(below, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fit_ordinal(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    prior: dict[int, float] | None = None,
    rounds: int = 150,
    l2: float = 1e-5,
    least_texts: int = LEAST_TEXTS,
) -> Ordinal:
    """Fit to rows of (grade, buckets, times) by Adam on the whole sample.

    Grades weigh the same, or as ``prior`` says.  Without rows, or with one grade
    only, every text has that grade.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    grades = sorted({r[0] for r in rows}) or [0]
    model = Ordinal(np.zeros(BUCKETS), np.linspace(-1, 1, len(grades) - 1), grades)
    if len(grades) < 2:
        return model
    y = np.array([grades.index(r[0]) for r in rows])
    sizes = np.array([len(r[1]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    bucket = np.concatenate([r[1] for r in rows]).astype(np.int64)
    times = np.concatenate([r[2] for r in rows]).astype(float)
    total = np.bincount(owner, times, len(rows))
    common = np.bincount(bucket, minlength=BUCKETS) >= least_texts
    owner, bucket, times = owner[common[bucket]], bucket[common[bucket]], times[common[bucket]]
    value = times / np.sqrt(np.maximum(total, 1))[owner]
    weight = np.array([1.0 if prior is None else prior[g] for g in grades])
    share = (weight / np.bincount(y))[y]
    share /= share.sum()
    # The first threshold and the steps to the next, which stay positive.
    first, gaps = -1.0, np.full(len(grades) - 2, np.log(2.0 / max(1, len(grades) - 2)))
    state = {k: [0.0, 0.0] for k in ("w", "first", "gaps")}
    for step in range(1, rounds + 1):
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(owner, value * model.weights[bucket], len(rows))
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = _sigmoid(edge[y + 1] - score), _sigmoid(edge[y] - score)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = share * hi * (1 - hi) / p, share * lo * (1 - lo) / p
        dtheta = np.bincount(y, -dhi, len(grades))[:-1] + np.bincount(y, dlo, len(grades))[1:]
        dscore = dhi - dlo
        grad = {
            "w": np.bincount(bucket, dscore[owner] * value, BUCKETS) + l2 * model.weights,
            "first": dtheta.sum(),
            "gaps": np.array([dtheta[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps),
        }
        move = {}
        for k, g in grad.items():
            m, v = state[k]
            state[k] = [0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g]
            m, v = state[k][0] / (1 - 0.9**step), state[k][1] / (1 - 0.99**step)
            move[k] = (0.3 if k == "w" else 0.05) * m / (np.sqrt(v) + 1e-9)
        model.weights = model.weights - move["w"]
        first, gaps = first - move["first"], gaps - move["gaps"]
    model.thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return model


# On Spark


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from ``quality`` and ``toxic``: 0 toxic, 1 poor, 2 good.

    Rows without both ratings are left out; of several ratings the lowest counts.
    """
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, texts: int = SAMPLE_TEXTS) -> Ordinal:
    """Fit on about ``texts`` rated texts, as many of each grade, drawn by a hash.

    What comes to the driver is a row of at most ``BUCKETS`` counts per text.
    """
    sizes = {r["grade"]: r["count"] for r in grades.groupBy("grade").count().collect()}
    if not sizes:
        return fit_ordinal([])
    prior = {g: float(n) ** PRIOR_POWER for g, n in sizes.items()}
    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col("grade") == g, F.lit(texts / len(sizes) / n)).otherwise(share)
    drawn = grades.where(F.pmod(F.xxhash64("doc_id", F.lit("grade")), F.lit(1 << 30)) < share * (1 << 30))
    # About ``texts`` rows, so it may be broadcast.
    rated = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column("text")):
                part = batch.slice(start, stop - start)
                buckets, offsets = features(part.column("text"))
                counted = [
                    np.unique(buckets[a:b], return_counts=True)
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("grade").cast(pa.int32()),
                        pa.array([c[0] for c in counted], pa.list_(pa.int32())),
                        pa.array([c[1] for c in counted], pa.list_(pa.int32())),
                    ],
                    names=["grade", "buckets", "times"],
                )

    schema = "grade int, buckets array<int>, times array<int>"
    got = rated.select("grade", "text").mapInArrow(run, schema).toArrow()
    own = [[x.values.to_numpy() for x in got.column(k)] for k in ("buckets", "times")]
    return fit_ordinal(list(zip(got.column("grade").to_pylist(), *own, strict=True)), prior)


def grade(docs: DataFrame, model: Ordinal, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``doc_id, expected_grade, tail, kept`` of every row of ``docs``.

    ``tail`` is the probability of the top grade.  A null or wordless text has
    the score 0 and is not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column("text")):
                part = batch.slice(start, stop - start)
                buckets, offsets = features(part.column("text"))
                p = model.probabilities(model.scores(buckets, offsets))
                tail = p[:, -1]
                kept = (tail >= least_tail) & (np.diff(offsets) > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p @ np.array(model.grades, float)), pa.array(tail), pa.array(kept)],
                    names=["doc_id", "expected_grade", "tail", "kept"],
                )

    only = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return only.mapInArrow(run, "doc_id long, expected_grade double, tail double, kept boolean")
