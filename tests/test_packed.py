"""Windows counted in numpy, and what documents are made of."""

from __future__ import annotations

import hashlib
from collections import Counter

import model
import pyarrow as pa
import pytest

from wordmine.functions import packed
from wordmine.operators import ngrams
from wordmine.queries import all_queries
from wordmine.session import together

# A doc_id comes twice, one is null, one text is null, one empty; wide characters.
ROWS = [(1, "abab"), (2, "蝴蝶飞a"), (1, "bab"), (None, "xx"), (3, None), (4, ""), (None, "xx\U0001f600"), (5, "a")]


def digest(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16)


def expected(n: int) -> Counter:
    out = Counter()
    for key, text in ROWS:
        for word, times in model.ngrams([text or ""], n).items():
            out[key, word] += times
    return out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_digests():
    words = ["", "a", "蝴蝶飞来了", "\x01" * 13, "b" * 55]
    assert packed.digests(pa.array(words)).tolist() == [digest(w) for w in words]
    assert packed.digests(pa.array([*words, "c" * 56])).tolist() == [digest(w) for w in [*words, "c" * 56]]


@pytest.mark.parametrize("size", [1, 5, 12, 4_000_000])
@pytest.mark.parametrize("n", [2, 6])
def test_slices_of_any_size_give_the_same_counts(monkeypatch, size, n):
    monkeypatch.setattr(packed, "SLICE", size)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    keys, texts = (pa.array(c) for c in zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays([keys, texts.cast(pa.string())], names=["key", "text"])
    got, whole = Counter(), Counter()
    for out in packed.counting(n, 1, True, digest=True)(iter([batch.slice(0, 3), batch.slice(3)])):
        for r in out.to_pylist():
            got[r["key"], r["word"]] += r["n"]
            whole[r["key"], r["word"]] += r["whole"] or 0
            assert r["digest"] == digest(r["word"])
            if r["whole"]:
                assert r["n"] == expected(n)[r["key"], r["word"]]
    assert got == expected(n)
    assert max(whole.values()) <= 1


def test_ngrams_are_counted_where_they_are_made(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, clause string").repartition(3)
    rows = ngrams.explode_ngrams(together(df, "doc_id"), 6, by="doc_id")
    assert {(r["doc_id"], r["word"]): r["n"] for r in rows.collect()} == expected(6)
    assert rows.where("not whole").isEmpty()


def write(spark, path, rows, times: int = 1) -> str:
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_the_query_ngrams_moves_texts_and_sums_only(spark, tmp_path):
    df = all_queries()["ngrams"](spark, write(spark, tmp_path, ROWS))
    assert "hashpartitioning(doc_id" in plan(df)
    assert ", word" not in "".join(x for x in plan(df).splitlines() if "hashpartitioning" in x)
    got = {(r["doc_id"], r["size"]): (r["occurrences"], r["kinds"], r["digest"]) for r in df.collect()}
    want = {}
    for key in (1, None, 5):
        clauses = [t.replace("\U0001f600", "") for k, t in ROWS if k == key]
        counts = model.ngrams(clauses, 6)
        for size in {len(w) for w in counts}:
            of = {w: c for w, c in counts.items() if len(w) == size}
            want[key, size] = (sum(of.values()), len(of), sum(c * digest(w) for w, c in of.items()))
    assert {k: v for k, v in got.items() if k[0] != 2} == want


def test_the_query_shingles_moves_texts_and_sums_only(spark, tmp_path):
    rows = [(1, "ab abc"), (None, "x"), (1, "abababababab"), (None, "x-"), (2, ""), (3, None)]
    df = all_queries()["shingles"](spark, write(spark, tmp_path, rows))
    exchanges = [x for x in plan(df).splitlines() if "hashpartitioning" in x]
    assert exchanges and not any(", s#" in x for x in exchanges)
    got = {r["doc_id"]: (r["occurrences"], r["kinds"], r["squares"], r["digest"]) for r in df.collect()}
    want = {}
    for key in (1, None):
        counts = Counter()
        for text in (t for k, t in rows if k == key):
            text = "".join(c for c in text if c.isalpha())
            counts.update((text + "\x01" * 6)[i : i + 7] for i in range(len(text)))
        n = counts.values()
        want[key] = (sum(n), len(n), sum(x * x for x in n), sum(x * digest(w) for w, x in counts.items()))
    assert got == want


def test_shingles_by_document(spark):
    df = together(spark.createDataFrame([(1, "aba"), (1, "aba"), (2, "")], "doc_id long, text string"), "doc_id")
    rows = ngrams.shingles(df, 2, by="doc_id").collect()
    assert {(r["doc_id"], r["s"]): r["n"] for r in rows} == {(1, "aba"): 2, (1, "ba\x01"): 2, (1, "a\x01\x01"): 2}


def test_padded_ngrams_are_counted_before_they_move(spark):
    texts = ["abab", "", None, "蝴蝶飞蝴蝶\U0001f600", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    grams = ngrams.padded_ngrams(df, 3)
    assert plan(grams).count("Exchange") == 1 and "Generate" not in plan(grams)
    want = model.ngrams([f"\x01{t}\x01" for t in texts if t], 4)
    del want["\x01"]
    assert {r["word"]: r["freq"] for r in grams.collect()} == want
