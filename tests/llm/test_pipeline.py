from __future__ import annotations

import re

import corpus_pipeline
from wordmine.llm import pii

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame(
        [(-1, "12 34 -- ??", "en", "s", 5), (-2, None, None, None, None), (-3, "", "en", "s", 0)], table.schema
    )
    docs, kept = table.unionAll(extra), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == table.columns
        kept[name] = docs.collect()
    start = {r["doc_id"]: r["text"] for r in table.collect()}

    first = {r["doc_id"] for r in kept["language_id"]}
    assert first == set(start)

    sets = {d: shingles(start[d]) for d in first}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(d)
    low = {d: d for d in first}
    links = [
        (d, o)
        for d, s in sets.items()
        for o in {o for x in s for o in by[x] if o < d}
        if 100 * len(s & sets[o]) >= 75 * len(s | sets[o])
    ]
    for _ in first:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not changed:
            break
    second = {r["doc_id"] for r in kept["ngram_jaccard_join"]}
    assert second == {d for d in first if low[d] == d}

    items = [" ".join(r["text"].split()[1:]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {d for d in second if any(i in " ".join(start[d].split()) for i in items)}
    third = {r["doc_id"] for r in kept["benchmark_decontamination"]}
    assert leaks and third == second - leaks

    for r in kept["pii"]:
        text = start[r["doc_id"]]
        assert not pii.base_spans(r["text"])
        if not pii.base_spans(text) and "<" not in r["text"]:
            assert r["text"] == text
    assert {r["doc_id"] for r in kept["pii"]} == third

    packed = kept["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == third
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 2048


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
