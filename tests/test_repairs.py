"""Owned tables, plans, and cases that once went wrong."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from conftest import SMALL

from wordmine import discover_v1
from wordmine.operators import cohesion, filters, freedom, ngrams, ranking
from wordmine.operators.clean import wash
from wordmine.queries import all_queries, documents, stopwords
from wordmine.session import materialize, running_sums, scratch
from wordmine.sources import read_corpus


def stored(spark) -> set[str]:
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {p.name for p in folder.glob("wordmine-*")}


def test_a_job_leaves_nothing_behind(spark):
    before = stored(spark)
    with scratch(spark):
        found = discover_v1(documents(spark, SMALL), stopwords(spark, SMALL), word_filter=4, min_freq=5)
        assert found.count() and stored(spark) > before
    assert stored(spark) == before


def test_a_failed_job_leaves_nothing_behind(spark):
    before = stored(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialize(spark.range(5))
        with scratch(spark):
            materialize(spark.range(5))
        assert len(stored(spark)) == len(before) + 1
        raise ZeroDivisionError
    assert stored(spark) == before


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_padded_texts_are_washed_once(spark):
    texts = wash(documents(spark, SMALL), "a-zA-Z").select("text")
    text = plan(ngrams.padded_ngrams(texts, 6))
    assert text.count("[^a-zA-Z]+") == 1


def test_counts_need_no_freedom(spark):
    for name in ("part_freq", "cohesion", "assoc_mi"):
        assert "ln(" not in plan(all_queries()[name](spark, SMALL)).split("assoc")[0] or name == "assoc_mi"


def test_exchanges(spark, words):
    grams = spark.createDataFrame([("ab", 3), ("a", 5), ("b", 4)], "word string, freq bigint")
    kept = [line for line in plan(ranking.number_by(grams, "freq")).split("\n") if "hashpartitioning(word" in line]
    assert not kept  # numbered rows are not dealt out again
    table = materialize(grams)
    text = plan(cohesion.cohesion(table.where("length(word) = 2"), table, ngrams.length_from_grams(table).scalar(), 2))
    keys = re.findall(r"HashAggregate\(keys=\[word#\d+\]", text)
    assert keys and not re.search(r"keys=\[word#\d+, freq", text)


def test_edge_marks_may_be_letters(spark, words):
    df = words("3ab", "dab", "abd", "a.b", ".ab")
    kept = {r["word"] for r in filters.drop_edge_marks(df, "d").collect()}
    assert kept == {"3ab", "a.b", ".ab"}
    assert {r["word"] for r in filters.drop_edge_marks(df, ".").collect()} == {"3ab", "dab", "abd", "a.b"}


def test_single_characters_have_no_freedom(spark):
    rows = [("a", 9), ("ab", 4), ("ac", 5), ("abx", 2), ("aby", 2), ("xab", 1), ("yab", 3)]
    grams = spark.createDataFrame(rows, "word string, freq bigint")
    stats = {r["word"]: r for r in freedom.word_statistics(grams, 2, 2).collect()}
    assert stats["a"]["freedom"] is None and stats["a"]["right_freedom"] is None
    assert stats["ab"]["freedom"] > 0


def test_malformed_bytes_fail_or_are_replaced(spark, tmp_path):
    (tmp_path / "gbk.txt").write_bytes("蝴蝶".encode("gbk") + b"\xff\n" + b"ok\n")
    read = lambda **more: read_corpus(spark, str(tmp_path), encoding="GBK", **more)
    with pytest.raises(Exception, match="MALFORMED"):
        read().collect()
    got = {r["text"] for r in read(malformed="replace").collect()}
    assert got == {"蝴蝶�", "ok"}


def test_unified_jobs(spark, corpus):
    docs = corpus(*["Ab１ x", "aB1 y", "AB１ z"] * 4)
    none = spark.createDataFrame([], "word string")
    limits = {"word_filter": 1, "min_freq": 2, "min_cohesion": 0, "min_freedom": 0}
    found = {r["word"]: r["freq"] for r in discover_v1(docs, none, unified=True, **limits).collect()}
    assert found["ab1"] == 12


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "1 as one").repartition(7)
    got = running_sums(df, ["g"], ["id"], ["one"]).collect()
    assert all(r["one_upto"] == r["id"] // 3 + 1 for r in got)
