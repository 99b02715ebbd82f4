from __future__ import annotations

import math
import random

import model
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wordmine import discover_padded, discover_v1, discover_v2, discover_v3
from wordmine.functions.text import CHUNK, PAD
from wordmine.operators import association, clean, cohesion, filters, freedom, ngrams
from wordmine.plans import discover
from wordmine.sources import read_corpus

WORKED = ("蝴蝶飞，蝴蝶来，看蝴蝶", "晒被子，盖被子，新被子好，被子厚")


def as_dict(df, *cols):
    return {r["word"]: tuple(r[c] for c in cols) for r in df.collect()}


def small(spark):
    return read_corpus(spark, f"{SMALL}/documents.parquet", fmt="parquet")


@pytest.fixture(scope="module")
def small_model(spark):
    texts = [r.text for r in small(spark).collect()]
    strings = [c for t in texts for c in model.clauses(t)]
    return texts, strings, model.ngrams(strings, 6)


def test_worked_corpus(corpus):
    df = corpus(*WORKED)
    clauses = clean.clauses(df)
    assert clauses.count() == 7
    assert ngrams.corpus_length(clauses).first().total == 22
    known = discover.frequent_words(df, 2, 3)
    free = as_dict(known, "freq", "right_freedom", "left_freedom", "freedom")
    assert free["蝴蝶"] == (3, pytest.approx(math.log(2), abs=1e-9), 0.0, 0.0)
    assert free["被子"][0] == 4
    assert free["被子"][1] == pytest.approx(math.log(2), abs=1e-9)
    assert free["被子"][2] == pytest.approx(math.log(3), abs=1e-9)
    table = as_dict(
        discover.features(filters.by_length_freq(known, 2, 3), known, 2),
        "freedom",
        "cohesion",
    )
    assert table["蝴蝶"] == (0.0, 3 * 22 / 3 / 3)
    assert table["被子"][1] == 4 * 22 / 4 / 4
    assert set(as_dict(filters.positive_freedom(known.where("length(word) > 1")))) == {
        "被子"
    }


def test_dictionary_against_the_model(spark, small_model):
    _, _, grams = small_model
    got = {r.word: r.freq for r in ngrams.corpus_ngrams(small(spark), 6).collect()}
    assert got == grams
    counted = ngrams.count_ngrams(clean.clauses(small(spark)), 6)
    assert {r.word: r.freq for r in counted.collect()} == grams


def test_features_against_the_model(spark, small_model):
    _, strings, grams = small_model
    known = discover.frequent_words(small(spark), 5, 5)
    words = filters.by_length_freq(known, 5, 5)
    got = as_dict(discover.features(words, known, 5), "freq", "freedom", "cohesion")
    total = sum(map(len, strings))
    free = model.freedoms(grams)
    expected = {g: f for g, f in grams.items() if 2 <= len(g) <= 5 and f >= 5}
    assert set(got) == set(expected)
    for word, (freq, fd, coh) in got.items():
        assert freq == grams[word]
        assert coh == model.cohesion(word, grams, total)
        assert fd == pytest.approx(min(free[word]), abs=2e-9)
        assert 0 < coh <= total


def test_both_ways_to_freedom_agree(spark):
    grams = ngrams.corpus_ngrams(small(spark), 6)
    cols = ("freq", "right_freedom", "left_freedom", "freedom")
    one = as_dict(
        freedom.word_statistics(grams, 5, 24).where("length(word) > 1"), *cols
    )
    words = filters.by_length_freq(grams, 5, 24)
    assert one == as_dict(freedom.freedom(words, grams), *cols)


def test_freedom_positive_means_two_neighbours_on_each_side(spark, small_model):
    _, _, grams = small_model
    right, left = {}, {}
    for g in grams:
        if len(g) > 1:
            right.setdefault(g[:-1], set()).add(g[-1])
            left.setdefault(g[1:], set()).add(g[0])
    known = discover.frequent_words(small(spark), 5, 5).where("length(word) > 1")
    for r in known.collect():
        two = min(len(right.get(r.word, ())), len(left.get(r.word, ()))) >= 2
        assert (r.freedom > 0) == two


def test_tiny_freedom_stays_positive(spark):
    rows = [("ab", 10**13 + 1), ("abx", 10**13), ("aby", 1), ("xab", 5), ("yab", 5)]
    grams = spark.createDataFrame(rows, "word string, freq bigint")
    stats = as_dict(freedom.word_statistics(grams, 2, 2), "freedom", "left_freedom")
    assert stats["ab"][0] > 0
    assert stats["ab"][1] == pytest.approx(math.log(2), abs=1e-9)


def test_texts_longer_than_a_piece(corpus):
    rng = random.Random(5)
    sizes = [1, CHUNK - 1, CHUNK, CHUNK + 1, CHUNK + 5, 2 * CHUNK, 1000]
    texts = ["".join(rng.choice("ab蝴") for _ in range(n)) for n in sizes]
    df = clean.clauses(corpus(*texts))
    for n in (1, 2, 6):
        got = {r.word: r.freq for r in ngrams.count_ngrams(df, n).collect()}
        assert got == model.ngrams(texts, n)


def test_empty_strings_hold_no_ngram(corpus):
    df = corpus("", "ab").withColumnRenamed("text", "clause")
    grams = ngrams.explode_ngrams(df, 3)
    assert sorted(r.word for r in grams.collect()) == ["a", "ab", "b"]


def test_result_does_not_depend_on_partitions(spark, words):
    docs = small(spark)
    stop = words("the", "of")
    args = {"word_filter": 4, "min_freq": 5}
    one = discover_v1(docs.coalesce(1), stop, **args).collect()
    many = discover_v1(docs.repartition(13), stop, **args).collect()
    assert sorted(one) == sorted(many) and len(one) > 0


def test_minimum_slice(spark, words):
    found = discover_v1(small(spark), words(), word_filter=4, min_freq=5)
    assert found.columns == ["word", "freq", "cohesion", "freedom"]
    assert found.count() == 32


def test_hot_clause_and_hot_character(corpus, words):
    texts = ["我们的，" * 3000, "我们的好，你们的，他们在"] + [f"的{i}" for i in range(50)]
    df = corpus(*texts, partitions=3)
    grams = model.ngrams([c for t in texts for c in model.clauses(t)], 6)
    got = {r.word: r.freq for r in ngrams.corpus_ngrams(df, 6).collect()}
    assert got == grams


def test_short_dictionary_gives_longest_words_no_freedom(corpus, words):
    df = corpus(*WORKED)
    known = discover.frequent_words(df, 2, 3, ngram_len=2)
    assert {r.freedom for r in known.where("length(word) = 2").collect()} == {0.0}
    none = discover_v2(df, words(), 3, 1, 99, 0.1, max_len=2)
    assert none.count() == 0
    some = discover_v2(df, words(), 3, 1, 99, 0.1, max_len=3)
    assert [r.word for r in some.collect()] == ["被子"]


def test_short_dictionary_equals_long_one_below_its_length(spark):
    docs = small(spark)
    short = discover.frequent_words(docs, 5, 24, ngram_len=5)
    full = discover.frequent_words(docs, 5, 24)
    cols = ("freq", "freedom")
    free = "length(word) > 1 AND freedom > 0"
    assert as_dict(short.where(free), *cols) == as_dict(
        full.where(free + " AND length(word) < 5"), *cols
    )


def test_empty_corpus(spark, words):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert discover_v1(empty, words()).count() == 0
    assert discover_v3(empty, words(), words("a")).count() == 0
    assert discover_padded(empty).count() == 0
    assert ngrams.corpus_length(clean.clauses(empty)).first().total == 0


def test_lexicon_without_match_selects_nothing(corpus, words):
    assert discover_v3(corpus(*WORKED), words(), words("zz"), 2, 3).count() == 0


def test_lexicon_words_can_stay(corpus, words, tmp_path, spark):
    df, lexicon = corpus(*WORKED), words("被子")
    kept = discover_v3(df, words(), lexicon, 2, 3, False, str(tmp_path / "stages"))
    assert [r.word for r in kept.collect()] == ["被子"]
    assert discover_v3(df, words(), lexicon, 2, 3).count() == 0
    for name, rows in {"left_freedom": 2, "freedom": 2, "features": 1}.items():
        assert spark.read.parquet(str(tmp_path / "stages" / name)).count() == rows


def test_association_by_hand(spark):
    rows = [("a", 4), ("b", 5), ("ab", 3)]
    grams = spark.createDataFrame(rows, "word string, freq bigint")
    words = grams.where("length(word) = 2")
    r = association.association(words, grams, F.lit(20)).first()
    ksi = 20 / 20
    assert r.ksi == ksi
    assert r.dice == 2 * 3 / 9
    assert r.mi == pytest.approx(math.log(3 / 20 / 20) + 2 * math.log(20))
    assert r.scp == pytest.approx(9 / 20)
    assert r.zscore == pytest.approx((3 - ksi) / math.sqrt(ksi * (1 - ksi / 20)))
    assert r.tscore == pytest.approx((3 - ksi) / math.sqrt(3 * (1 - 3 / 20)))


def test_association_without_variance_is_null(spark):
    grams = spark.createDataFrame([("a", 2), ("aa", 2)], "word string, freq bigint")
    words = grams.where("word = 'aa'")
    r = association.association(words, grams, F.lit(2)).first()
    assert r.tscore is None and r.zscore is None


def test_cohesion_of_two_letters_and_cap(spark):
    rows = [("a", 2), ("b", 2), ("ab", 2)]
    grams = spark.createDataFrame(rows, "word string, freq bigint")
    words = grams.where("length(word) = 2")
    assert cohesion.cohesion(words, grams, F.lit(10), 2).first().cohesion == 5.0
    capped = cohesion.cohesion(words, grams, F.lit(10), 2, cap=3)
    assert capped.first().cohesion == 3.0


def test_padded_features_against_the_model(spark, small_model):
    texts = [r.text for r in clean.wash(small(spark), "a-zA-Z").collect()]
    grams = model.ngrams(texts, 3)
    total = sum(map(len, texts))
    table = discover.padded_features(small(spark), 3, 200, "a-zA-Z")
    got = as_dict(table, "freq", "freedom", "cohesion")
    assert set(got) == {g for g, f in grams.items() if len(g) > 1 and f >= 200}
    for word in sorted(got)[::5]:
        freq, fd, coh = got[word]
        assert freq == grams[word]
        assert fd == pytest.approx(min(model.padded_freedom(texts, word)), abs=2e-9)
        assert coh == model.cohesion(word, grams, total)


def test_shingles(corpus):
    rows = ngrams.shingles(corpus("abab"), 2).collect()
    assert sorted(r.s for r in rows) == sorted(["aba", "bab", "ab" + PAD, "b" + 2 * PAD])
    counted = ngrams.count_shingles(ngrams.shingles(corpus("abab"), 2), 2, 2)
    assert as_dict(counted, "freq") == {"ab": (2,)}


def test_extensions_and_reversal(spark):
    rows = [("a", 3), ("ab", 2), ("ac", 1), ("ca", 1)]
    grams = spark.createDataFrame(rows, "word string, freq bigint")
    words = grams.where("word = 'a'")
    right = freedom.extensions(words, grams, "right").collect()
    left = freedom.extensions(words, grams, "left").collect()
    assert sorted(r.extension for r in right) == ["ab", "ac"]
    assert [(r.extension, r.extension_freq) for r in left] == [("ca", 1)]
    assert "ba" in as_dict(ngrams.reverse_grams(grams), "freq")


def test_same_result_when_nothing_is_small(spark, words):
    """Shuffled joins, with partitions split as if they were overfull."""
    stop = words("the", "of", "and")
    expected = sorted(discover_v1(small(spark), stop, word_filter=4).collect())
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1kb",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = discover_v1(small(spark), stop, word_filter=4)
        assert sorted(found.collect()) == expected
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_counting_plan(spark, capsys):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stats = freedom.word_statistics(ngrams.corpus_ngrams(docs, 6), 5, 24)
    plan = plan_of(stats, capsys)
    assert "ReadSchema: struct<text:string>" in plan
    tree = plan.split("(1) Scan")[0]
    assert tree.count("Exchange") == 4
    assert "Join" not in tree and "Python" not in tree


def test_lookup_plan(spark, capsys):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = discover.frequent_words(docs, 5, 24)
    words = filters.by_length_freq(known, 5, 24)
    plan = plan_of(discover.features(words, known, 5), capsys)
    assert "GreaterThanOrEqual(freq,24)" in plan
    assert "right_freedom" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 22])
def test_statistics_do_not_depend_on_the_filter(spark, bits):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcde", k=60)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "clause string")
    grams = ngrams.count_ngrams(df, 4).cache()
    maybe = freedom.word_filter(grams, 3, 20, bits)
    frequent = grams.where("freq >= 20 and length(word) between 2 and 3")
    assert frequent.where(~maybe(F.col("word"))).count() == 0
    if bits == 1 << 22:  # few words share a bit of very many
        rest = grams.where("freq < 20 and length(word) between 2 and 3")
        assert rest.where(maybe(F.col("word"))).count() <= 2
    got = {tuple(r) for r in freedom.word_statistics(grams, 3, 20, bits=bits).where("length(word) > 1").collect()}
    plain = freedom.freedom(frequent, grams).select("word", "freq", "right_freedom", "left_freedom", "freedom")
    assert got == {tuple(r) for r in plain.collect()} and got
    nothing = freedom.word_statistics(grams.where("false"), 3, 20, bits=bits)
    assert nothing.count() == 0
