from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from wordmine.llm import forest, trie


def sums(parents, column):
    total = list(column)
    depth = lambda v: 0 if parents[v] < 0 else 1 + depth(parents[v])
    for v in sorted(range(len(parents)), key=depth, reverse=True):
        if parents[v] >= 0:
            total[parents[v]] += total[v]
    return total


def shapes():
    rng = random.Random(3)
    yield "empty", []
    yield "one", [-1]
    yield "chain", [-1, *range(299)]
    yield "star", [-1, *[0] * 300]
    yield "caterpillar", [-1, *[v - 1 if v % 2 else max(0, v - 2) for v in range(1, 400)]]
    yield "random", [-1, *[rng.randrange(v) for v in range(1, 500)]]
    yield "deep", [-1, *[rng.randrange(max(0, v - 4), v) for v in range(1, 500)]]
    yield "forest", [rng.choice([-1, rng.randrange(v)]) if v else -1 for v in range(400)]


SHAPES = dict(shapes())


@pytest.mark.parametrize("name", SHAPES)
def test_one_part(name):
    parents = SHAPES[name]
    columns = [[1] * len(parents), [v * v % 17 - 5 for v in range(len(parents))]]
    assert forest.rolled_up(parents, columns) == [sums(parents, c) for c in columns]


@pytest.mark.parametrize("name", SHAPES)
def test_forest(spark, name):
    parents = SHAPES[name]
    names = [f"n{v}" for v in range(len(parents))]
    random.Random(5).shuffle(names)
    rows = [(names[v], names[p] if p >= 0 else None, 1, v * v % 17 - 5, 0) for v, p in enumerate(parents)]
    df = spark.createDataFrame(rows, "node string, parent string, size long, other long, top int")
    found = forest.subtree_sums(df.repartition(3), ["size", "other"], bound=16)
    assert found.columns == ["node", "size", "other"]
    expected = zip(names, sums(parents, [1] * len(parents)), sums(parents, [r[3] for r in rows]), strict=True)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_parts_are_bounded(spark):
    for name in ("chain", "star", "random"):
        parents = SHAPES[name]
        rows = [(v, p if p >= 0 else None) for v, p in enumerate(parents)]
        df = spark.createDataFrame(rows, "node long, parent long")
        largest = forest.parts(df, 16).groupBy("top").count().agg({"count": "max"}).first()[0]
        assert largest <= 16


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    mark = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
    for c in by:
        by[c] = [(r, x) for _, _, r, x in sorted(by[c], key=lambda t: (t[:2], mark(*t[2:])))]
    full = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(by.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + by[c][h:])
    members = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, own in members.items():
        k = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * k
            leaves[node[:d]] += node not in children
    out = []
    for node, own in members.items():
        ended = ",".join(str(c) for c in sorted(own) if full[c] == node)
        out.append(
            (
                min(own),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(own),
                len(children.get(node, [])),
                leaves[node],
                saved[node],
                hashlib.sha256(ended.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


COLUMNS = "conv_id long, turn long, role string, text string, key string, pos int, d long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], COLUMNS)


def test_trie(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(-25, 90), 205, 222, 10**15]:
        if c % 7:
            for t in range(rng.randrange(1, 7)):
                text = rng.choice([None, "", "same words here", "a b", "é É\n x", f"own {rng.random()}"])
                rows.append((c, t, rng.choice(["user", None, ""]), text))
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (6, 2, "user", "b"), (6, 2, "user", "a")]
    rows += [(None, 1, "user", "nobody's"), (3, 4, "user", "long " * 20_000)]
    # Many with the same turns, and one with many turns.
    rows += [(c, t, "user", f"hi {t}") for c in range(1000, 1130) for t in range(4)]
    rows += [(2001, t, "user", "again") for t in range(600)]
    rows += rows[:30]
    rng.shuffle(rows)
    assert got(table(spark, rows).repartition(3)) == brute(rows)


def test_nothing(spark):
    df = trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))
    assert df.collect() == []
    # One turn of its own, and three to take from a conversation that is absent.
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert got(table(spark, [(lone, 0, "user", "x")])) == brute([(lone, 0, "user", "x")])


def test_many_ends(spark):
    rows = [(f"k{c % 2 * (c % 3)}", c) for c in range(-20, 9_000)]
    df = spark.createDataFrame(rows, "key string, conv_id long").repartition(5)
    expected = {}
    for k, c in sorted(rows, key=lambda r: r[1]):
        expected.setdefault(k, []).append(str(c))
    expected = {k: hashlib.sha256(",".join(ids).encode()).hexdigest() for k, ids in expected.items()}
    assert {r["key"]: r["ends_sha256"] for r in trie.ends(df).collect()} == expected
