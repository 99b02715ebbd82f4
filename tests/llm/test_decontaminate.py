from __future__ import annotations

from itertools import product
from random import Random

from pyspark.sql import Row

from wordmine.llm import decontaminate
from wordmine.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"
ITEM = "If Anna buys 12 apples for 3 dollars each and Anna then sells 12 of them how much money does she have"


def found(spark, texts, items=(ITEM,), **more):
    docs = spark.createDataFrame([Row(doc_id=i, text=x, item_id="x", pos=1) for i, x in enumerate(texts)], "doc_id long, text string, item_id string, pos long")
    bench = spark.createDataFrame([(i, x, "y") for i, x in enumerate(items)], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench, **more).collect()}


def test_other_numbers_names_and_units(spark):
    other = "If Bert buys 7 apples for 9 euros each and Bert then sells 7 of them how much money does she have"
    mixed = "If Bert buys 7 apples for 9 euros each and Carl then sells 8 of them how much money does she have"
    far = "word " * 20000 + ITEM + " end" * 3000
    texts = [ITEM, other, mixed, None, "", " ", "If Anna buys", far, "again and " + other, "so " * 50]
    for limit in (2_000_000, 0):
        got = found(spark, texts, broadcast_windows=limit)
        assert set(got) == {(0, 0), (1, 0), (7, 0), (8, 0)}
        assert not got[0, 0]["reparameterised"] and got[1, 0]["reparameterised"]
        assert got[0, 0]["n_matched"] == got[0, 0]["n_windows"]


def test_short_and_empty_items(spark):
    got = found(spark, ["of the day", "the sum of these", "12 13"], ["of the day", "", None, "5 6"])
    assert set(got) == {(0, 0)}
    assert found(spark, ["a b c"], []) == {} and found(spark, [], ["a b c"]) == {}


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(4, ITEM)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 4)]
    kept = decontaminate.drop_contaminated(docs, bench).collect()
    assert [r["doc_id"] for r in kept] == [None]


def test_query_against_brute_force(spark):
    rows = all_queries()["op1_decontamination"](spark, SMALL).collect()
    read = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet").collect()
    items = {r["item_id"]: r["text"].split() for r in read("benchmark")}
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in read("documents")}
    whole = {(d, i) for d, t in docs.items() for i, w in items.items() if " ".join(w[1:]) in t}
    runs_of_12 = {
        (d, i)
        for d, t in docs.items()
        for i, w in items.items()
        if any(" ".join(w[k : k + 12]).lower().strip(".,") in t.lower() for k in range(max(1, len(w) - 11)))
    }
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert whole and whole <= got <= runs_of_12


def test_one_clash_does_not_discard_the_rest(spark):
    altered = ITEM.replace("sells 12", "sells 13")
    renamed = ITEM.replace("and Anna", "and Bert")
    chance = "When Anna picks 2 apples and then walks for 2 hours to the old market she sells all of it and buys some bread"
    other = chance.replace("Anna", "Bert").replace("2 apples", "3 apples").replace("2 hours", "5 hours")
    got = found(spark, [altered, renamed, other], [ITEM, chance])
    assert set(got) == {(0, 0), (1, 0), (2, 1)}
    assert all(r["reparameterised"] for r in got.values())


def test_windows_that_fit_together():
    v = lambda at, a, b, named=False: {"a": a, "b": b, "at": at, "named": named}
    two = [[v(1, 5, 7)], [v(1, 5, 7)], [v(9, 5, 8)], [v(9, 5, 5)], []]
    assert decontaminate._fitting(two) == [True, True, False, True, True]
    names = [[v(1, 5, 7, True)], [v(9, 5, 8, True)], []]
    assert decontaminate._fitting(names) == [False, False, True]
    assert decontaminate._fitting([*names, [v(12, 5, 8, True)]]) == [False, True, True, True]
    many = [[v(9 * k, 100 + k, 7)] * 2 + [v(9 * k + 4, 100 + k, 7)] for k in range(20)]
    more = [[v(9 * k + 8, 100 + k, 8)] for k in range(20)]
    assert decontaminate._fitting(many + more + more) == [False] * 20 + [True] * 40



def test_choices_against_exhaustive_search():
    rng = Random(5)
    for case in range(300):
        values = rng.randrange(2, 6)
        wide = rng.randrange(1, 4)
        windows = [
            tuple(sorted({a: rng.randrange(rng.randrange(1, 5)) for a in rng.sample(range(values), min(wide, values))}.items()))
            for _ in range(rng.randrange(1, 25))
        ]
        groups = sorted({w: windows.count(w) for w in windows}.items())
        fitting = lambda chosen: sum(n for g, n in groups if all(chosen[a] == b for a, b in g))
        best = max(fitting(chosen) for chosen in product(range(4), repeat=values))
        got, chosen = decontaminate._best(groups, 1000)
        assert got == best, case
        assert fitting({a: chosen.get(a) for a in range(values)}) == best
        assert decontaminate._best(groups, 1000, best) is None
        for enough in range(best):
            assert enough <= decontaminate._best(groups, enough)[0] <= best


def test_many_values_with_many_choices():
    """Beyond any number of combinations that could be tried one by one."""
    rng = Random(6)
    v = lambda at, a, b: {"a": a, "b": b, "at": at, "named": False}
    right = [[v(9 * k, k % 40, 1000 + k % 40), v(9 * k + 1, (k + 1) % 40, 1000 + (k + 1) % 40)] for k in range(80)]
    other = [[v(9 * k + 4, k % 40, rng.randrange(6)), v(9 * k + 5, (k + 1) % 40, rng.randrange(6))] for k in range(80)]
    assert decontaminate._fitting(right + other) == [True] * 80 + [False] * 80


def test_names_that_open_sentences(spark):
    item = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have?"
    once = "Mary sold 48 clips in April and half as many in May so how many clips were sold"
    inside = once.replace("Mary", "Then Bob").replace("48", "90")
    texts = [item.replace("Tom", "Ann"), "so " + item.replace("Tom", "Ann"), inside, item.replace("apples", "x")]
    got = found(spark, texts, [item, once])
    assert set(got) == {(0, 0), (1, 0), (2, 1)}
    assert got[0, 0]["n_matched"] == got[0, 0]["n_windows"] == 7


def test_short_items_in_long_documents(spark):
    items = ["The capital of France?", "of the day", "name 5 rivers"]
    texts = ["we asked for the capital of France and more", "a b of the day c d e f g h", "so name 7 rivers of the world in a row",
             "Now tell me. Your capital of France?", "of the", "The capital of Peru is not known to us at all"]
    for limit in (2_000_000, 0):
        got = found(spark, texts, items, broadcast_windows=limit)
        assert set(got) == {(0, 0), (1, 1), (2, 2), (5, 0)}
