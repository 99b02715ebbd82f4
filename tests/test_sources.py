from __future__ import annotations

from types import SimpleNamespace

import pytest

from wordmine import (
    discover_padded,
    read_corpus,
    read_words,
    write_ranked,
    write_stages,
    write_words,
)
from wordmine.session import checkpoint_dir, materialize


def test_text_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("蝴蝶飞\n\n看蝴蝶\n", encoding="utf-8")
    df = read_corpus(spark, str(tmp_path / "c.txt"), partitions=3)
    assert df.rdd.getNumPartitions() >= 3
    rows = df.collect()
    assert sorted(r.text for r in rows) == ["", "看蝴蝶", "蝴蝶飞"]
    assert len({r.doc_id for r in rows}) == 3


def test_gbk(spark, tmp_path):
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    text = "蝴蝶飞，\x01\"蝴蝶\"来\n看蝴蝶\n"
    (tmp_path / "g.txt").write_bytes(text.encode("gbk"))
    df = read_corpus(spark, str(tmp_path / "g.txt"), encoding="GBK")
    assert sorted(r.text for r in df.collect()) == sorted(text.split("\n")[:2])
    whole = read_corpus(spark, str(tmp_path / "g.txt"), encoding="GBK", whole_files=True)
    assert [r.text for r in whole.collect()] == [text]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_gbk_file_as_one_text(spark, tmp_path):
    lines = ["晒被子盖被子", "新被子被子厚"]
    (tmp_path / "g.txt").write_bytes("\n".join(lines).encode("gbk"))
    df = read_corpus(spark, str(tmp_path / "g.txt"), encoding="GBK", whole_files=True)
    found = discover_padded(df, 2, 3, freedom=0.1, cohesion=1).collect()
    assert [(r.word, r.freq) for r in found] == [("被子", 4)]


def test_word_list_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes("﻿我们\n因此\n我们\n 的\n".encode())
    got = sorted(r.word for r in read_words(spark, str(tmp_path / "w.txt")).collect())
    assert got == sorted(["我们", "因此", " 的"])


def test_write_and_refuse(spark, tmp_path):
    df = spark.createDataFrame([("被子", 4, 0.5, 5.5)], "word string, freq bigint, freedom double, cohesion double")
    path = str(tmp_path / "out")
    write_words(df, path)
    assert spark.read.parquet(path).collect() == df.collect()
    with pytest.raises(Exception, match="exist"):
        write_words(df, path)
    write_words(df, str(tmp_path / "csv"), fmt="csv")
    write_stages({"a": df, "b": df}, str(tmp_path / "stages"))
    assert spark.read.parquet(str(tmp_path / "stages" / "b")).count() == 1


def test_ranked_files_in_order(spark, tmp_path):
    rows = [(f"w{i}", i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "word string, freq bigint")
    write_ranked(df, str(tmp_path / "ranked"))
    lines = []
    for part in sorted((tmp_path / "ranked").glob("part-*")):
        lines += part.read_text().split()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert lines == [f"{w},{f}" for w, f in want]


def test_materialize_writes_to_the_named_folder(spark):
    df = spark.range(3)
    back = materialize(df)
    assert back.schema.names == ["id"] and back.count() == 3
    assert all(checkpoint_dir(spark) in f for f in back.inputFiles())


def test_a_cluster_must_name_its_shared_folder():
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(cluster)
