from __future__ import annotations

import numpy as np
import pyarrow as pa

from wordmine.llm import quality
from wordmine.llm.queries import all_queries


def rows_of(texts, grades):
    out = []
    for t, g in zip(texts, grades, strict=True):
        b, _ = quality.features(pa.array([t]))
        u, n = np.unique(b, return_counts=True)
        out.append((g, u, n))
    return out


def test_ordinal_fit():
    rng = np.random.default_rng(0)
    good, poor, bad = (lambda k, w=w: " ".join(rng.choice(w, k)) for w in (["alpha", "beta", "gamma"], ["alpha", "BUY!!", "beta"], ["idiot", "clown", "BUY!!"]))
    texts = [f(20) for f in (bad, poor, good) for _ in range(40)]
    grades = [g for g in (0, 1, 2) for _ in range(40)]
    model = quality.fit_ordinal(rows_of(texts, grades))
    again = quality.fit_ordinal(rows_of(texts[::-1], grades[::-1]))
    assert (model.weights == again.weights).all()
    assert (np.diff(model.thresholds) > 0).all()
    p = model.probabilities(model.scores(*quality.features(pa.array(texts))))
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == grades).mean() > 0.95


def test_features_of_odd_texts():
    texts = [None, "", " ", "a", "***", "a a a a", "Ab ABC x1 é!?", "w " * 40_000]
    buckets, offsets = quality.features(pa.array(texts))
    assert np.diff(offsets).tolist() == [0, 0, 0, 2, 2, 8, 8, 80_000]
    assert buckets.min() >= 0 and buckets.max() < quality.BUCKETS
    assert len(set(buckets[1::2].tolist())) > 4 and buckets[1::2].max() < quality.SHAPES
    assert quality.features(pa.array([], pa.string()))[1].tolist() == [0]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "a b", 0), (3, "a b", 0)], "doc_id long, text string, grade int")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.grades_of(empty))
    got = quality.grade(docs, model).collect()
    assert len(got) == 5 and [r["kept"] for r in got].count(True) == 3
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (2, 1, 1), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in quality.grades_of(labels).collect()} == {3: 1, 2: 0}
    model = quality.fit(docs, quality.grades_of(labels))
    assert model.grades == [0, 1] and quality.grade(docs.limit(0), model).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in all_queries()["op4_ordinal_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] and not r["toxic"]]
    toxic = [rows[r["doc_id"]]["kept"] for r in labels if r["toxic"]]
    assert np.mean(good) > 0.95 and np.mean(toxic) < 0.1
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows.values())
