from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from wordmine.llm import langid
from wordmine.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"


def test_runs_of_letters():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é.1 \nZ", k=rng.randrange(12))) for _ in range(1500)]
    texts += [None, "", "a" * 60, "b", "é" * 20 + "."]
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        pieces, first = langid.letter_runs(pa.array(part, pa.string()))
        pieces = pieces.to_pylist()
        assert first[0] == 0 and first[-1] == len(pieces)
        for i, text in enumerate(part):
            want = []
            for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
                w = w.translate(bytes(langid.LOWER.tolist()))
                cuts = [w[j : j + 24] for j in range(0, len(w), 24)]
                want += [*cuts[:-1], cuts[-1] + b" "]
            assert pieces[first[i] : first[i + 1]] == want


def test_gradients():
    net = langid.new_network(["a", "b", "c"], hidden=4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rows = np.random.default_rng(0).integers(97, 105, (5, 6)).astype(np.uint8)
    answer = np.array([0, 1, 2, 0, 1])
    _, grad = net.gradients(rows, answer)
    for k, v in net.weights.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
        keep, losses = v[at], []
        for step in (1e-5, -1e-5):
            v[at] = keep + step
            losses.append(net.gradients(rows, answer)[0])
        v[at] = keep
        assert abs((losses[0] - losses[1]) / 2e-5 - grad[k][at]) < 1e-5


def test_training_is_repeatable_and_every_position_is_labelled():
    samples = [("x", b"abab ", 5), ("x", b"aba ", 2), ("y", b"cdcd ", 5), ("y", b"dcd ", 1)]
    one, two = (langid.train(s, steps=150, batch=16) for s in (samples, samples[::-1]))
    assert all((one.weights[k] == two.weights[k]).all() for k in one.weights)
    p = one.positions(np.frombuffer(b"ababcdcd", np.uint8).reshape(2, 4))
    assert p.shape == (2, 4, 2) and (p[0, :, 0] > 0.8).all() and (p[1, :, 1] > 0.8).all()


def test_odd_texts(spark):
    net = langid.train([("x", b"abab ", 5), ("y", b"cdcd ", 5)], steps=150, batch=16)
    texts = [None, "", " 12 --", "🙂 ", "abab", "x" * 90_000, "cdcd 1 CDCD", "日本"]
    rows = [(i, t, None, "z", 1.0) for i, t in enumerate(texts)] + [(4, "abab", None, "z", 1.0), (None, "abab", None, "z", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.predictions(docs, net).collect()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and by[0]["score"] == 0
    assert by[4]["lang_pred"] == "x" and by[6]["lang_pred"] == "y" and by[7]["lang_pred"] in "xy"
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 10
    assert {i: r["held_out"] for i, r in by.items() if i is not None} == {
        i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(8)
    }
    none = langid.fit(docs)  # no row has a language
    assert {r["lang_pred"] for r in langid.predictions(docs, none).collect()} == {"und"}
    assert langid.predictions(docs.limit(0), net).count() == 0


def test_query_on_held_out_documents(spark):
    rows = all_queries()["op5_language_id"](spark, SMALL).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in out)
    assert right >= 0.97 * len(out)


def test_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.limit(1).selectExpr("-1L as doc_id", "'12 34 --' as text", "lang", "source", "n_chars")
    kept = langid.keep_identified(docs.unionAll(more))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()}


def test_trigrams():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aB é1 .", k=rng.randrange(9))) for _ in range(400)] + [None, "", "x"]
    for k in range(0, len(texts), 5):
        ids, first = langid.trigrams(pa.array(texts[k : k + 5], pa.string()))
        for i, text in enumerate(texts[k : k + 5]):
            raw = bytes(langid.LOWER.tolist()[b] if langid._LETTER[b] else 32 for b in (text or "").encode())
            raw = b" " + raw + b" "
            want = [int.from_bytes(raw[j - 1 : j + 2], "big") for j in range(1, len(raw) - 1) if raw[j] != 32]
            assert ids[first[i] : first[i + 1]].tolist() == want


FOREIGN = {
    "ru": "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
    "zh": "幸福的家庭都是相似的，不幸的家庭各有各的不幸。",
    "pl": "Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa jest nieszczęśliwa na swój sposób.",
    "el": "Όλες οι ευτυχισμένες οικογένειες μοιάζουν μεταξύ τους",
}


def test_stage_rejects_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame(
        [(-k, text, lang, "s", 1) for k, (lang, text) in enumerate(FOREIGN.items(), 1)], docs.schema
    )
    known = langid.known_trigrams(docs)
    assert known.foreign(pa.array(list(FOREIGN.values()))).all()
    texts = docs.select("text", "lang").toPandas()
    assert not known.foreign(pa.array(texts["text"])).any()
    for lang in ("fr", "de", "es"):
        without = langid.known_trigrams(docs.where(f"lang <> '{lang}'"))
        foreign = without.foreign(pa.array(texts["text"]))
        own = (texts["lang"] == lang).to_numpy()
        assert foreign[own].mean() > 0.85 and foreign[~own].mean() < 0.02
    # The stage: labelled or not, nobody learned of these few texts.
    unlabelled = more.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    kept = {r["doc_id"] for r in langid.keep_identified(docs.unionAll(unlabelled)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
