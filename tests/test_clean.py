from __future__ import annotations

import random
from collections import Counter

import model
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wordmine.operators import clean
from wordmine.sources import read_corpus

EDGES = {
    "价格1.5元.好 3.14.15": ["价格1.5元", "好", "3.14.15"],
    r"abc\r\nxy\tz\n": ["abc", "xy", "z"],
    "电话13812345678联系": ["电话", "联系"],
    "a@b|c": ["abc"],
    "1.2.3": ["1.2.3"],
    "１.２x": [".x"],
    "12345é678z": ["z"],
    "[a]{b}": ["a", "b"],
    ".5 5.": ["5", "5"],
    "café—x…y　z": ["cafxyz"],
    "蝴蝶,X*-\\": ["蝴蝶", "X*-\\"],
    r"a\rb": [r"a\rb"],
    "1..2": ["1", "2"],
    "": [],
    " ., ": [],
    "𝟏.𝟐a": ["a"],
}


def found(df):
    rows = clean.clauses(df).orderBy("doc_id", "pos").collect()
    assert all(r.pos >= 0 for r in rows)
    return [r.clause for r in rows]


@pytest.mark.parametrize("text", EDGES)
def test_edge_strings(corpus, text):
    assert found(corpus(text)) == EDGES[text]


def test_positions_count_clauses(corpus):
    rows = clean.clauses(corpus("..a..b12345678c ")).orderBy("pos").collect()
    assert [(r.pos, r.clause) for r in rows] == [(0, "a"), (1, "b"), (2, "c")]


def test_all_small_documents_against_the_model(spark):
    docs = read_corpus(spark, f"{SMALL}/documents.parquet", fmt="parquet")
    texts = [r.text for r in docs.collect()]
    expected = Counter(c for t in texts for c in model.clauses(t))
    got = clean.clauses(docs).groupBy("clause").count().collect()
    assert {r[0]: r[1] for r in got} == expected
    weighted = clean.weighted_clauses(docs).groupBy("clause").agg(F.sum("w")).collect()
    assert {r[0]: r[1] for r in weighted} == expected


def test_steps_add_up_to_clauses(corpus):
    df = corpus(*EDGES)
    steps = clean.split_clauses(df)
    steps = clean.keep_meaningful(steps)
    steps = clean.split_long_digits(clean.split_escapes(steps))
    assert sorted(r.text for r in steps.collect()) == sorted(sum(EDGES.values(), []))


def test_long_runs_of_marks_do_not_overflow(corpus):
    text = "ab" + " ." * 300_000 + "cd" + "é" * 300_000 + "1" * 300_000 + "e"
    assert found(corpus(text)) == ["ab", "cd", "e"]


def test_null_text_gives_no_clause(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert clean.clauses(df).count() == 0
    assert clean.weighted_clauses(df).count() == 0


def test_wash_and_unify(corpus):
    df = corpus("蝴Ab12蝶,é１〇九")
    assert clean.wash(df).first().text == "蝴蝶九"
    assert clean.wash(df, "a-zA-Z").first().text == "Ab"
    assert clean.unify(df).first().text == "蝴Ab12蝶,é１〇九"
    both = clean.unify(df, case=True, digits=True).first().text
    assert both == "蝴ab12蝶,é109"


def test_random_texts_against_the_model(corpus):
    rng = random.Random(11)
    bits = list(",，。.. ..\n[]{}()X*-|é　１２0123456789ab蝴龥龦一") + [r"\n", r"\r\n", r"\t", "\\"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(600)]
    rows = clean.clauses(corpus(*texts)).orderBy("doc_id", "pos").collect()
    got = {i: [] for i in range(len(texts))}
    for r in rows:
        got[r.doc_id].append(r.clause)
    assert got == {i: model.clauses(t) for i, t in enumerate(texts)}
    weighted = clean.weighted_clauses(corpus(*texts)).collect()
    counted = Counter()
    for r in weighted:
        counted[r.clause] += r.w
    assert counted == Counter(c for t in texts for c in model.clauses(t))
