from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from wordmine.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, g string, block int, node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [None if v is None else str(v) for v in (*row[:4], text)]
    return H(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and the siblings of every node, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, j in zip(paths, at, strict=True):
            run, k = nodes[j // 8 * 8 : j // 8 * 8 + 8], j % 8
            path.append((run[:k], run[k + 1 :]))
        at = [j // 8 for j in at]
        nodes = [H(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        found[lang] = tree([leaf(r, r[4]) for r in by[lang]])
    if not langs:
        return []
    root, upper = tree([found[lang][0] for lang in langs])
    out = []
    for lang, rest in zip(langs, upper, strict=True):
        subroot, paths = found[lang]
        for r, path in zip(by[lang], paths, strict=True):
            path = [*path, *rest]
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = leaf(r, text)
            for a, b in path:
                d = H(*a, d, *b)
            proof = H(*[x for a, b in path for x in a + b])
            out.append((r[0], leaf(r, r[4]), subroot, root, proof, d, d == root))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in merkle.manifest(df, **options).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLUMNS)


@pytest.mark.parametrize(("n", "levels"), [(1, 4), (8, 4), (9, 1), (64, 1), (65, 1), (300, 1), (700, 2)])
def test_sizes(spark, n, levels):
    rng = random.Random(n)
    rows = [(i, "s", "en", i, f"Text {rng.random()}") for i in range(n)]
    rng.shuffle(rows)
    assert got(table(spark, rows).repartition(3), levels=levels) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    langs = [None, "", "en", "de", "Zz", "éa"] + [f"l{k}" for k in range(12)]
    rows = [
        (rng.choice([None, i, i, i, -i]), rng.choice([None, "", "web"]), rng.choice(langs), rng.choice([None, 3]), t)
        for i, t in enumerate([None, "", "A", "é É", "x" * 50_000, "-", "1:x"] * 30)
    ]
    rows += rows[:40] + [(7, "a", "en", 1, "same")] * 25
    rng.shuffle(rows)
    for levels in (1, 4):
        assert got(table(spark, rows).repartition(4), levels=levels) == brute(rows)


def test_empty(spark):
    df = merkle.manifest(table(spark, []))
    assert df.collect() == []
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_witnesses_grow():
    nodes = [merkle.digest(bytes([k])) for k in range(70)]
    witnesses = merkle.Witnesses()
    for k, node in enumerate(nodes):
        witnesses.append(node)
        # Seven siblings at most, those before on the left and those since on the right.
        left, right = witnesses.steps[0][k // 8 * 8]
        assert bytes(left) == b"" and bytes(right) == b"".join(nodes[k // 8 * 8 + 1 : k + 1])
    root = witnesses.root(None)
    assert all(merkle.fold(node, witnesses.path(k)) == root for k, node in enumerate(nodes))
