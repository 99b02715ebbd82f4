"""The index: the same results as without it, and no rows moved by its lookups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wordmine.operators import cohesion as coh
from wordmine.operators import freedom as fr
from wordmine.operators.filters import by_length_freq
from wordmine.operators.ngrams import corpus_ngrams
from wordmine.plans.discover import total_of
from wordmine.plans.index import DictionaryIndex, build_index
from wordmine.session import materialize

TEXTS = ["abab, xyab abq", "ab xy zab, ab", "b", "", "aaaa aaa ab", "it's ab\\'s"] * 6


@pytest.fixture
def grams(spark, corpus):
    return materialize(corpus_ngrams(corpus(*TEXTS), 5))


@pytest.fixture
def no_broadcast(spark):
    """As with tables too large to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_same_results_and_no_exchange(spark, grams, tmp_path, no_broadcast):
    words = by_length_freq(grams, 4, 6)
    with build_index(grams, words, str(tmp_path / "it's"), 5) as index:
        same = by_length_freq(index.words(), 4, 6)
        assert rows(index.words(), "word", "freq") == rows(grams, "word", "freq")
        for side in ("right", "left"):
            cols = ("word", "extension", "extension_freq")
            got = index.extensions(same, side)
            assert exchanges(got) == 0 < exchanges(fr.extensions(words, grams, side))
            assert rows(got, *cols) == rows(fr.extensions(words, grams, side), *cols)
        cols = ("word", "freq", "right_freedom", "left_freedom", "freedom")
        got = index.freedom(same)
        assert exchanges(got) == 0 < exchanges(fr.freedom(words, grams))
        assert rows(got, *cols) == rows(fr.freedom(words, grams), *cols)
        cols = ("word", "freq", "k", "side", "part", "part_freq")
        got = index.part_freq(same)
        assert exchanges(got) == 0
        assert rows(got, *cols) == rows(coh.lookup_freq(coh.parts(words), grams), *cols)
        got = index.cohesion(same, total_of(grams), 4)
        plain = coh.cohesion(words, grams, total_of(grams), 4)
        assert exchanges(got) < exchanges(plain)
        assert rows(got, "word", "freq", "cohesion") == rows(plain, "word", "freq", "cohesion")


def test_opened_again(spark, grams, tmp_path):
    path = str(tmp_path / "index")
    words = by_length_freq(grams, 4, 6)
    build_index(grams, words, path, 3).close()
    with DictionaryIndex(spark, path + "/") as index:
        assert index.buckets == 3
        assert rows(index.words(), "word", "freq") == rows(grams, "word", "freq")
        names = {t.name for t in spark.catalog.listTables()}
        assert set(index._names.values()) <= names
    assert not set(index._names.values()) & {t.name for t in spark.catalog.listTables()}
    with pytest.raises(FileExistsError):
        build_index(grams, words, path)


def test_half_an_index_is_refused_and_written_again(spark, grams, tmp_path):
    path = str(tmp_path / "index")
    bad = grams.select(F.raise_error(F.lit("parts")).cast("string").alias("word"), "freq")
    with pytest.raises(Exception, match="parts"):
        build_index(grams, bad, path, 2)
    with pytest.raises(FileNotFoundError):
        DictionaryIndex(spark, path)
    with build_index(grams, by_length_freq(grams, 4, 6), path, 2) as index:
        assert index.words().count() == grams.count()


def test_empty_dictionary(spark, corpus, tmp_path):
    grams = materialize(corpus_ngrams(corpus(""), 5))
    with build_index(grams, grams, str(tmp_path / "index"), 2) as index:
        assert index.freedom(index.words()).count() == 0
        assert index.part_freq(index.words()).count() == 0
