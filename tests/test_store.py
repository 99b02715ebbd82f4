"""Dictionaries of a corpus that grows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrameWriter

from wordmine import DictionaryStore, read_corpus
from wordmine.operators.ngrams import corpus_length, corpus_ngrams
from wordmine.operators.clean import clauses, unify

TEXTS = {"a.txt": "abc ab, abcd\nab", "b.txt": "xyz ab\n", "c.txt": "AB xy\n蝴蝶，蝴蝶", "empty.txt": ""}


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "texts"
    where.mkdir()
    for name, text in TEXTS.items():
        (where / name).write_text(text)
    return where


def words(df):
    return {r["word"]: r["freq"] for r in df.collect()}


def whole(spark, folder, n=3):
    return words(corpus_ngrams(read_corpus(spark, str(folder)), n))


def test_parts_add_up_to_the_whole(spark, folder, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "store"), 3)
    assert words(store.dictionary()) == {} and store.corpus_length().first()["total"] == 0
    assert store.add(str(folder / "a.txt")) == 1
    assert words(store.dictionary()) == whole(spark, folder / "a.txt")
    # Known files are not counted again, alone or among others.
    assert store.add(str(folder / "a.txt")) == 0 and len(store.batches()) == 1
    assert store.add([str(folder / "a.txt"), str(folder / "b.txt")]) == 1
    assert store.add(str(folder)) == 1  # an empty file is none
    assert words(store.dictionary()) == whole(spark, folder)
    length = corpus_length(clauses(read_corpus(spark, str(folder))))
    assert store.corpus_length().first() == length.first()
    assert store.inputs().count() == len(TEXTS) - 1 and len(store.batches()) == 3
    # Merged, and opened again.
    store.compact()
    again = DictionaryStore(spark, str(tmp_path / "store") + "/", 3)
    assert len(again.batches()) == 1 and words(again.dictionary()) == whole(spark, folder)
    assert again.add(str(folder)) == 0
    assert again.clean() == 3 and words(again.dictionary()) == whole(spark, folder)
    assert again.clean() == 0


def test_a_failed_run_leaves_nothing(spark, folder, tmp_path, monkeypatch):
    store = DictionaryStore(spark, str(tmp_path / "store"), 3)
    store.add(str(folder / "a.txt"))
    before = words(store.dictionary())
    write = DataFrameWriter.parquet

    def fail_on_inputs(self, path, *args, **kwargs):
        if path.endswith("/inputs"):
            raise RuntimeError("lost")
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", fail_on_inputs)
    with pytest.raises(RuntimeError, match="lost"):
        store.add(str(folder))
    monkeypatch.undo()
    assert words(store.dictionary()) == before and store.clean() == 0
    assert store.add(str(folder)) == 2 and words(store.dictionary()) == whole(spark, folder)


def test_what_is_refused(spark, folder, tmp_path):
    path = str(tmp_path / "store")
    store = DictionaryStore(spark, path, 3)
    store.add(str(folder))
    (folder / "b.txt").write_text("other contents")
    with pytest.raises(ValueError, match="changed"):
        store.add(str(folder))
    os.utime(folder / "a.txt", (1, 1))
    with pytest.raises(ValueError, match="changed"):
        store.add(str(folder / "a.txt"))
    with pytest.raises(ValueError, match="made with"):
        DictionaryStore(spark, path, 4)
    # Another job published in the meantime.
    late = DictionaryStore(spark, path, 3)
    late._version = lambda: 0
    (folder / "d.txt").write_text("new")
    with pytest.raises(FileExistsError):
        late._commit(0, [], store.dictionary(), store.inputs())


def test_unified(spark, folder, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "store"), 2, unified=True)
    store.add(str(folder))
    docs = unify(read_corpus(spark, str(folder)), case=True, digits=True)
    assert words(store.dictionary()) == words(corpus_ngrams(docs, 2))
