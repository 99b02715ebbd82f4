"""Pruned, stored and applied rules."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wordmine import apply_rules, discover_v3, learn_rules, read_rules, write_rules
from wordmine.operators.filters import positive_freedom
from wordmine.plans.discover import features, frequent_words, total_of
from wordmine.plans.learning import Rules, expected_errors, pruned, rule_features, rules_table

Z = 0.6744897501960817


def upper(pos, neg):
    """The share of errors at which a quarter of samples would show as few."""
    n, e = pos + neg, min(pos, neg)
    low, high = e / n, 1.0
    for _ in range(200):
        p = (low + high) / 2
        low, high = (p, high) if (p - e / n) <= Z * math.sqrt(p * (1 - p) / n) else (low, p)
    return n * low


@pytest.mark.parametrize(("pos", "neg"), [(0, 6), (1, 15), (7, 9), (300, 2), (5.5, 40)])
def test_expected_errors(pos, neg):
    # The end of the Wilson interval solves (p - f) = z * sqrt(p * (1 - p) / n).
    assert expected_errors(pos, neg, Z) == pytest.approx(upper(pos, neg))
    assert expected_errors(pos, neg, Z) == expected_errors(neg, pos, Z)
    assert expected_errors(0, 0, Z) == 0


def test_pruning_by_hand():
    rules = Rules(("a", "b"), {1: ("a", 1.0), 2: ("b", 2.0), 3: ("b", 5.0)})
    # Node 2 parts its rows well; node 3 gains nothing by its split.
    counts = {4: (40.0, 0.0), 5: (0.0, 30.0), 6: (3.0, 20.0), 7: (3.0, 19.0)}
    out = pruned(rules, counts, 0.25)
    assert out.limits == {1: ("a", 1.0), 2: ("b", 2.0)}
    assert out.leaves == {4: 1.0, 5: 0.0, 3: 0.0}
    # The less is trusted, the more goes.
    stump, few = Rules(("a",), {1: ("a", 1.0)}), {2: (1.0, 3.0), 3: (4.0, 3.0)}
    assert pruned(stump, few, 0.25) == Rules(("a",), stump.limits, {2: 0.0, 3: 1.0})
    assert pruned(stump, few, 0.05) == Rules(("a",), {}, {1: 0.0})
    assert pruned(rules, {}, 0.25) == Rules(("a", "b"), {}, {1: 0.0})


def noise(spark, n=3000):
    rows = spark.range(n).selectExpr(
        "concat('w', id) as word",
        "xxhash64(id) % 500 as freq",
        "(xxhash64(id, 1) % 100000) / 1000.0D as freedom",
        "(xxhash64(id, 2) % 1000) / 7.0D as cohesion",
    )
    return rows, rows.selectExpr("word", "int(xxhash64(word) % 10 = 0) as label")


def test_noise_is_pruned_and_a_rule_is_not(spark):
    rows, random = noise(spark)
    assert len(learn_rules(rows, random, max_depth=4).limits) > 3
    assert learn_rules(rows, random, max_depth=4, prune=0.25).limits == {}
    real = rows.selectExpr("word", "int(freq > 100 and cohesion <= 20) as label")
    grown = learn_rules(rows, real, max_depth=5)
    kept = learn_rules(rows, real, max_depth=5, prune=0.25)
    assert kept.limits and len(kept.limits) <= len(grown.limits)
    for rules in (grown, kept):
        both = apply_rules(rules, rows).join(real, "word")
        assert both.where("label <> prediction").count() == 0


def test_stored_rules(spark, tmp_path):
    rows, labels = noise(spark, 500)
    rules = learn_rules(rows, labels, max_depth=3)
    write_rules(spark, rules, str(tmp_path / "rules"))
    again = read_rules(spark, str(tmp_path / "rules"))
    assert again == rules and again.text() == rules.text()
    with pytest.raises(Exception, match="(?i)exist"):
        write_rules(spark, rules, str(tmp_path / "rules"))
    # A tree that is one leaf, and one that nothing was learnt from.
    for k, lone in enumerate((Rules(("freq",), {}, {1: 1.0}), Rules(("freq",)))):
        write_rules(spark, lone, str(tmp_path / f"lone{k}"))
        got = read_rules(spark, str(tmp_path / f"lone{k}"))
        assert [r.prediction for r in apply_rules(got, rows.limit(1)).collect()] == [float(k == 0)]
    for k, bad in enumerate(("false", "node = 2")):
        rules_table(spark, rules).where(bad).write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError, match="no tree"):
            read_rules(spark, str(tmp_path / f"bad{k}"))


TEXTS = ["abcab xyab abz", "abq cab zab, xy xyz ab", "abab xyxy qab abw", "xyab abxy ab xyq"] * 9


def measured(docs):
    known = frequent_words(docs, 3, 5)
    return rule_features(features(positive_freedom(known), known, 3), known, total_of(known))


def test_job_with_learnt_rules(spark, corpus, words):
    docs, none = corpus(*TEXTS), words()
    some = {"max_len": 3, "min_freq": 5}
    everything = Rules(("freq",), {}, {1: 1.0})
    found = discover_v3(docs, none, words("ab"), learnt=everything, **some)
    assert found.columns == discover_v3(docs, none, words("ab"), **some).columns
    all_words = {r.word for r in found.collect()}
    assert all_words and "ab" not in all_words
    # A limit on one of the five measures, and the job with the known words kept.
    kept = discover_v3(docs, none, words("ab"), exclude_lexicon=False, learnt=everything, **some)
    scores = {r.word: r.tscore for r in measured(docs).collect() if r.word in ("ab", "xy")}
    low, high = sorted(scores, key=scores.get)
    limit = Rules(("tscore",), {1: ("tscore", scores[low])}, {2: 0.0, 3: 1.0})
    found = discover_v3(docs, none, words("ab"), exclude_lexicon=False, learnt=limit, **some)
    found, kept = ({r.word for r in df.collect()} for df in (found, kept))
    assert kept == all_words | {"ab"} and high in found and low not in found and low in kept
    nothing = Rules(("freq",), {}, {1: 0.0})
    assert discover_v3(docs, none, words("ab"), learnt=nothing, **some).count() == 0


def test_rule_features(spark, corpus):
    known = frequent_words(corpus(*TEXTS), 3, 5)
    table = features(positive_freedom(known), known, 3)
    three = rule_features(table, known, total_of(known), ("freq", "cohesion"))
    assert three.columns == ["word", "freq", "cohesion"]
    eight = measured(corpus(*TEXTS))
    assert len(eight.columns) == 9 and eight.count() == three.count() == table.count()
    first = eight.orderBy("word").first()
    exact = table.where(F.col("word") == first["word"]).first()
    assert first["freq"] == exact["freq"] and first["cohesion"] == round(exact["cohesion"], 6)
