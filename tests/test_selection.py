from __future__ import annotations

import math

import pytest

from wordmine import apply_rules, learn_rules
from wordmine.operators import filters, lexicon, ranking, rules, scaling

COLS = "word string, freq bigint, freedom double, cohesion double"


@pytest.fixture
def table(spark):
    rows = [
        ("aa", 10, 1.0, 20.0),
        ("bb", 20, 2.0, 30.0),
        ("cc", 30, 0.5, 500.0),
        ("dd", 5, 3.0, 5.0),
    ]
    return spark.createDataFrame(rows, COLS)


def picked(df):
    return "".join(sorted(r.word[0] for r in df.collect()))


def test_rules(table):
    assert picked(rules.select_all3(table, 10, 20, 1.0)) == "ab"
    assert picked(rules.select_band(table, 0.5, 20, 500)) == "abc"
    assert picked(rules.select_min_cohesion(table)) == "abc"
    assert picked(rules.select_strict(table, 1.0, 20)) == "b"
    assert picked(rules.select_vote(table, 10, 1.0, 20, 500)) == "ab"
    assert picked(rules.select_vote(table, 10, 9.0, 20, 501)) == "bc"


def test_envelope(table, words):
    limits = lexicon.lexicon_envelope(table, words("aa", "bb", "zz"))
    assert limits.first() == (1.0, 2.0, 20.0, 30.0)
    assert picked(rules.select_envelope(table, limits)) == "ab"
    assert picked(lexicon.known_words(table, words("aa"))) == "a"
    assert picked(lexicon.new_words(table, words("aa"))) == "bcd"


def test_filters(spark, words):
    rows = [(w, 24) for w in ("ab", ".ab", "a-", "*a", "123", "12a", "a.b", "abcdef", "a")]
    grams = spark.createDataFrame([*rows, ("xy", 25)], "word string, freq bigint")

    def kept(df):
        return {r.word for r in df.collect()}

    assert kept(filters.drop_edge_marks(grams)) == {
        "ab", "123", "12a", "a.b", "abcdef", "a", "xy"
    }
    assert "*a" in kept(filters.drop_edge_marks(grams, ".-"))
    assert "123" not in kept(filters.drop_all_digits(grams))
    assert kept(filters.by_length_freq(grams, 5, 24, True)) == {"xy"}
    stop = words("ab", "ab")
    assert kept(filters.candidates_v1(grams, stop, 5, 24)) == {"xy"}
    assert kept(filters.candidates_v2(grams, stop, 5, 24)) == {"12a", "a.b", "xy"}
    assert kept(filters.candidates_v3(grams, stop, 3, 24)) == {
        ".ab", "a-", "*a", "123", "12a", "a.b", "xy"
    }
    assert kept(filters.candidates_v31(grams, stop, 5, 23)) == {
        "*a", "12a", "a.b", "xy"
    }


def test_moments_and_scaling(table):
    r = scaling.feature_moments(table, ["freq"]).first()
    xs = [10, 20, 30, 5]
    mean = sum(xs) / 4
    spread = math.sqrt(sum((x - mean) ** 2 for x in xs)) / 4
    assert r.freq_mean == mean and r.freq_spread == pytest.approx(spread)
    z = {r.word: r.freq for r in scaling.zscale(table, ["freq"]).collect()}
    assert z["cc"] == pytest.approx((30 - mean) / spread)
    m = {r.word: r.freq for r in scaling.minmax(table, ["freq"]).collect()}
    assert m == {"aa": 0.2, "bb": 0.6, "cc": 1.0, "dd": 0.0}
    q = {r.word: r.freq for r in scaling.squash(table, ["freq"]).collect()}
    assert q["cc"] == pytest.approx(1 - math.exp(-1))
    s = {r.word: r.score for r in scaling.score(table, {"freq": 2.0}).collect()}
    assert s["bb"] == pytest.approx(1.2)
    logs = {r.word: r.score for r in scaling.score(table, {"freq": 1}, True).collect()}
    assert logs["aa"] == pytest.approx(math.log(11 / 6) / math.log(31 / 6))


def test_scaling_of_nothing_and_of_constants(table):
    assert scaling.zscale(table.where("freq < 0")).count() == 0
    same = table.where("word = 'aa'")
    assert scaling.minmax(same).first().freq is None
    assert scaling.zscale(same).first().freq is None


def test_ranking(spark):
    rows = [(f"w{i:04d}", (i * 7919) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "word string, freq bigint").repartition(5)
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in ranking.rank_by(df, "freq").collect()] == expected
    numbered = ranking.number_by(df, "freq").orderBy("rank").collect()
    assert [(r.word, r.freq) for r in numbered] == expected
    assert [r["rank"] for r in numbered] == list(range(1, 501))


def test_learnt_rules(spark):
    rows = [(f"w{i}", i, i / 100, 40.0 if i % 2 else 10.0) for i in range(200)]
    table = spark.createDataFrame(rows, COLS)
    labels = spark.createDataFrame([(f"w{i}", i % 2) for i in range(100)], "word string, label int")
    model = learn_rules(table, labels)
    got = {r.word: r.prediction for r in apply_rules(model, table).collect()}
    assert got == {f"w{i}": float(i % 2) for i in range(200)}
    assert model.text() == "If cohesion <= 10.0\n  Predict 0.0\nElse\n  Predict 1.0"


def test_rules_do_not_depend_on_the_layout(spark):
    rows = spark.range(60_000).selectExpr(
        "concat('w', id) as word",
        "xxhash64(id) % 5000 as freq",
        "(xxhash64(id, 1) % 100000) / 1000.0D as freedom",
        "case when id % 7 = 0 then null else (xxhash64(id, 2) % 1000) / 7.0D end as cohesion",
    )
    labels = rows.selectExpr("word", "int(freq > 1000 and (freedom < 3 or freq % 11 = 0)) as label")
    found = [
        learn_rules(rows.repartition(n), labels.repartition(n), max_depth=3, balance=True)
        for n in (3, 11)
    ]
    assert found[0] == found[1] and len(found[0].limits) > 2


def test_rules_of_few_rows(spark, table):
    none = spark.createDataFrame([], "word string, label int")
    assert {r.prediction for r in apply_rules(learn_rules(table, none), table).collect()} == {0.0}
    one = spark.createDataFrame([("aa", 1), ("bb", 1)], "word string, label int")
    assert {r.prediction for r in apply_rules(learn_rules(table, one), table).collect()} == {1.0}
