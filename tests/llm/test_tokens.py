"""Token pieces, packing and id files against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from wordmine.llm import idfiles, packing, tokens
from wordmine.llm.queries import all_queries, vocabulary
from wordmine.session import materialize

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  a  b\n\n\tc", "don't  it's 'tis", "é e  x", "a　b c",
    "x́ ́y a̸= H̱", "<|endoftext|> a", "日本語 テスト。ok", "1234 5678a9", "ΑΣ ΑΣ.",
    "a" * 5000, "L'été D'S", "🙂 a🙂b", "\r\n a\r b", "word " * 9000,
]


def plain_ids(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(5)
    marks = " \n\t.,'\"aZé́ 　日1٣ßΣİ🙂-_<|>s t \x1c"
    texts = ODD + ["".join(rng.choices(marks, k=rng.randrange(30))) for _ in range(800)]
    path = vocabulary(name)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encoder = tokens.PieceEncoder(path, remember=50)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            want = t.encode(text or "", add_special_tokens=False).ids + [0]
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want


def test_code_round_trip():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 0, 3, 4, 5, 1000])
    ranks = rng.choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], lengths.sum())
    control, data = idfiles.encode(ranks, lengths)
    assert len(control) == ((lengths + 3) // 4).sum()
    assert idfiles.decode(control, data, lengths).tolist() == ranks.tolist()


def test_id_files(spark, tmp_path):
    rows = [Row(doc_id=i, text=x, lang="en", ids=1) for i, x in enumerate(reversed(ODD))]
    rows += [Row(doc_id=3, text="again", lang="en", ids=1), Row(doc_id=None, text="n", lang=None, ids=1)]
    path = vocabulary("byte_bpe_50k.json")
    stored = materialize(tokens.token_ids(spark.createDataFrame(rows).repartition(3), path))
    for digest in (False, True):
        out = str(tmp_path / f"ids{digest}")
        idfiles.write_ids(stored, out, block_ids=700)
        got = idfiles.read_ids(spark, out, digest=digest).collect()
        assert len(got) == len(rows)
        place = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == place
            place += r["n_tokens"]
        wanted = sorted((-1 if x.doc_id is None else x.doc_id, plain_ids(path, x.text)) for x in rows)
        if digest:
            crc = [(d, zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in wanted]
            assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == sorted(crc)
        else:
            found = sorted(
                (-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got
            )
            assert found == wanted


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = vocabulary("byte_bpe_50k.json")
    stored = materialize(tokens.token_ids(docs, path))
    idfiles.write_ids(stored, str(tmp_path / "none"))
    assert idfiles.read_ids(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(materialize(packing.token_pieces(docs, path))).count() == 0


def test_plan_fills_exactly():
    plan = packing.plan_sequences({6: 5, 4: 5, 3: 2, 2: 2, 5: 1, 10: 3}, 10)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 10
        for x in pattern:
            used[x] += times
    assert used == Counter({6: 5, 4: 5, 3: 2, 2: 2, 5: 1, 10: 3})
    assert sum(t for _, t in plan) == 10  # 95 ids; 9.5 sequences


def test_plan_on_random_lengths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(rng.integers(1, 2049, rng.integers(1, 3000)).tolist())
        plan = packing.plan_sequences(counts)
        used = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= 2048
            for x in pattern:
                used[x] += times
        assert used == counts


def check_packed(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= size
    return len(by)


def test_packed_sequences_hold_the_ids(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = [Row(doc_id=i % 7, text=x, offset="x") for i, x in enumerate(ODD)]
    pieces = materialize(packing.token_pieces(spark.createDataFrame(rows), path, keep_ids=True))
    packed = packing.pack(pieces, per_group=2).cache()
    check_packed(packed.collect())
    total = sum(len(plain_ids(path, x)) for x in ODD)
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * total
    whole = {r["sequence_id"]: r["ids"] for r in joined}
    for r in packed.collect():
        own = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(own) == r["ids_crc32"]


def test_packing_query(spark):
    rows = all_queries()["op3_best_fit_packing"](spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    pieces = {}
    for d, text in docs.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[d, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    found = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert found == pieces and len(rows) == len(pieces)
    used = check_packed(rows)
    total = sum(x[1] for x in pieces.values())
    assert used <= -(-total // 2048) * 1.02 + 1


def test_id_file_query(spark):
    rows = all_queries()["op10_token_id_files"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want, place = [], 0
    for r in docs:
        ids = np.array(t.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        want.append((r["doc_id"], place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == want


LITERALS = [
    "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> a", "x<|startoftext|><|endoftext|>", "<|endoftext|", "|>",
    "<|endof", "text|>", "<|<|endoftext|>|>", "é<|endoftext|>\u0301 日", "<|ENDOFTEXT|>", None, "it's<|endoftext|>'s",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_in_an_untouched_tokenizer(name):
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "a", "word", "é", ".", "\n", "endoftext"]
    texts = LITERALS + ODD + ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1500)]
    path = vocabulary(name)
    t = Tokenizer.from_file(path)
    encoder = tokens.PieceEncoder(path, remember=50, added=True)
    for whole in (False, True):
        encoder.whole = whole
        ids, offsets = encoder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            want = t.encode(text or "", add_special_tokens=False).ids + [0]
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, text


def test_queries_read_added_tokens(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate(LITERALS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, file in (("op10_token_id_files", "byte_bpe_50k.json"), ("op3_best_fit_packing", "word_bpe_49k.json")):
        t = Tokenizer.from_file(vocabulary(file))
        want = {
            i: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
            for i, x in rows
        }
        got = all_queries()[name](spark, str(tmp_path)).collect()
        assert {r["doc_id"]: r["ids_crc32"] for r in got} == want
