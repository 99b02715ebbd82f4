from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wordmine.llm import jaccard
from wordmine.llm.components import components
from wordmine.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    sets = []
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = {}
    for i, (d, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, set()).add(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            k = len(s & sets[j][1])
            if d is not None and sets[j][0] is not None and 100 * k >= 75 * (len(s) + len(sets[j][1]) - k):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        low[r] = d if r not in low or (d is not None and d < low[r]) else low[r]
    return sorted(((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_groups(df).collect()), key=str)


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("long_from", [128, 4])
def test_against_brute_force(spark, monkeypatch, long_from):
    monkeypatch.setattr(jaccard, "LONG", long_from)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef", k=3))
    text = lambda k: " ".join(word() for _ in range(k))
    base, passage = text(120), text(40)
    texts = near_copies(rng, base, 60, 8) + near_copies(rng, text(30), 25, 2)
    texts += [passage + " " + text(rng.randrange(5, 80)) for _ in range(40)]
    texts += [f"{passage} {passage[:k]}" for k in range(0, 150, 7)]
    texts += [None, "", " \n", "one two", "One TWO", "one two three", "é É", text(9000)] + [base.upper()] * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += rows[:5] + [(None, base), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, sig int, n string")
    assert got(df.repartition(3)) == brute(rows)


def test_tiles(spark):
    rng = random.Random(2)
    base = " ".join(f"w{k}" for k in range(60))
    rows = list(enumerate(near_copies(rng, base, 150, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = jaccard.LONG
    try:
        jaccard.LONG = 3
        texts, sets, links = jaccard.jaccard_join(df, block=16)
        found = {r["node"]: r["component"] for r in components(links).collect()}
    finally:
        jaccard.LONG = before
    want = {d: c for d, _, c in brute(rows)}
    same = {}
    for r in texts.join(sets, "sig").collect():
        same[r["doc_id"]] = found.get(r["rep"], r["rep"])
    assert same == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 3), (4, 4), (None, 1)]
    df = spark.createDataFrame(chain, "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3}


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_keep_one(spark):
    rows = [(2, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (3, None, "z"), (4, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = all_queries()["op6_ngram_jaccard_join"](spark, SMALL).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)
    assert found == brute([(r["doc_id"], r["text"]) for r in docs])


def test_one_row_of_each_group(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    near = a.replace("a0 ", "x ")
    schema = "doc_id long, text string, rows int, first string"

    def kept(*rows):
        df = spark.createDataFrame([(*r, 1, "z") if len(r) == 2 else r for r in rows], schema).repartition(3)
        out = jaccard.keep_one_of_each(df)
        assert out.columns == df.columns
        return sorted(((r["doc_id"], r["text"], r["rows"]) for r in out.collect()), key=str)

    # A distinct text stays though its id also stands for a copy; a repeated row stays once.
    assert kept((5, a), (5, a), (9, b), (9, a)) == [(5, a, 1), (9, b, 1)]
    assert kept((5, a), (5, b), (7, near)) == [(5, a, 1), (5, b, 1)]
    assert kept((5, a, 2, "z"), (5, a, 1, "z"), (5, a, 3, None)) == [(5, a, 1)]
    # Without an id: copies of a document, and copies of each other.
    assert kept((None, a), (8, a), (None, b), (None, b)) == [(8, a, 1), (None, b, 1)]
    # Nothing links to texts without words.
    assert kept((1, None), (1, None), (2, ""), (3, " ")) == [(1, None, 1), (1, None, 1), (2, "", 1), (3, " ", 1)]


def test_sketches_never_tell_a_link_apart():
    rng = np.random.default_rng(7)
    draw = lambda n: np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    pairs = []
    for n in (1, 3, 40, 60, 70, 500, 5000, 40000):
        a = draw(n)
        for share in (0.0, 0.3, 0.6, 0.74, 0.8, 0.857, 0.9, 1.0):
            pairs.append((a, np.unique(np.concatenate((a[: round(share * len(a))], draw(n - round(share * n)))))))
            pairs.append((a[: max(1, round(share * len(a)))], a))
    sets = [x for p in pairs for x in p]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    sketches = jaccard._sketches(np.concatenate(sets), offsets)
    n = pa.array(np.diff(offsets))
    ids = pa.array(np.arange(len(sets)))
    columns = [x.take(pa.array(np.arange(side, len(sets), 2))) for x in (ids, n, sketches) for side in (0, 1)]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb", "sa", "sb"])
    near = {r["a"] // 2 for out in jaccard._near_rows(iter([batch])) for r in out.to_pylist()}
    link, far = set(), set()
    for i, (a, b) in enumerate(pairs):
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            link.add(i)
        elif 500 <= len(a) <= 5000 and common < 0.4 * len(b):
            far.add(i)
    assert link and far and link <= near and not far & near


def test_texts_are_fetched_for_near_pairs_only(spark, monkeypatch):
    # The halves of a text and it share lists, but no half is near the whole.
    text = [f"w{i}" for i in range(400)]
    texts = [" ".join(text[a:b]) for a, b in ((0, 400), (0, 200), (200, 400), (1, 400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, sets, _ = jaccard._linked_sets(df)
    sig = {r["rep"]: r["sig"] for r in sets.collect()}
    every = spark.createDataFrame([(sig[a], sig[b]) for a in sig for b in sig if a < b], "a long, b long")
    asked = []
    fetch = jaccard._texts_of
    monkeypatch.setattr(
        jaccard, "_texts_of", lambda d, s, w: asked.extend(r["sig"] for r in w.collect()) or fetch(d, s, w)
    )
    links = {frozenset(r) for r in jaccard._probe(df, sets, every).collect()}
    assert links == {frozenset((sig[0], sig[3]))}
    assert set(asked) == {sig[0], sig[3]}
