"""A dictionary of a corpus that grows.

A store is a folder.  Every batch of files that was counted together is a folder
with two tables: ``words``, its dictionary, and ``inputs``, the files.  A manifest,
one text file per version, names the batches that count; the one with the highest
number holds.  A batch is written first and a manifest that names it last, by the
rename of one file, so a job that fails on the way leaves no trace in the counts,
and one that is run again counts nothing twice.

Frequencies of n-grams are sums over documents, so dictionaries of batches add up to
that of the whole.  Nothing that grows with the corpus reaches the driver but the
list of the new files, which Spark's own scan of them keeps there as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.operators.clean import unify
from wordmine.operators.ngrams import corpus_ngrams, length_from_grams
from wordmine.session import delete, file_system
from wordmine.sources.corpus import read_corpus

_WORDS = "word string, freq bigint"
_INPUTS = "path string, length bigint, modified timestamp"
_SETTINGS = "settings"


class DictionaryStore:
    """The n-gram dictionary, up to ``max_len`` characters, of all files added so far.

    ``options`` are those of ``read_corpus``; ``unified`` as in the jobs.  A store
    that exists must be opened with the ``max_len`` and ``unified`` it was made with.
    """

    def __init__(
        self, spark: SparkSession, path: str, max_len: int, unified: bool = False, **options
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.max_len, self.unified, self.options = max_len, unified, options
        settings = f"{max_len} {unified}"
        held = self._read(_SETTINGS)
        if held is None:
            self._publish(_SETTINGS, [settings])
        elif held != [settings]:
            raise ValueError(f"{path} was made with {held[0]}, not {settings}")

    # The folder

    def _read(self, name: str) -> list[str] | None:
        hadoop, fs = file_system(self.spark, self.path)
        if not fs.exists(hadoop(f"{self.path}/{name}")):
            return None
        return [r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect()]

    def _publish(self, name: str, lines: list[str]) -> None:
        """Write a small file aside and rename it; an existing one is refused."""
        hadoop, fs = file_system(self.spark, self.path)
        aside, place = (hadoop(f"{self.path}/{n}") for n in (f"_{uuid.uuid4().hex}", name))
        out = fs.create(aside, False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise FileExistsError(f"{self.path}/{name} was published by another job")

    def _version(self) -> int:
        hadoop, fs = file_system(self.spark, self.path)
        found = fs.globStatus(hadoop(f"{self.path}/manifest-*"))
        return max((int(f.getPath().getName().split("-")[1]) for f in found), default=0)

    def batches(self) -> list[str]:
        """The batches that count."""
        version = self._version()
        return self._read(f"manifest-{version:08d}") if version else []

    def _tables(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{b}/{name}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # Counting

    def inputs(self) -> DataFrame:
        """``path, length, modified`` of every file that was counted."""
        return self._tables("inputs", _INPUTS)

    def add(self, path: str | list[str]) -> int:
        """Count the files at ``path`` that were not counted before; how many were new.

        Files without contents are left alone.  A file that changed since it was counted is refused, as its old contents
        cannot be taken out again.
        """
        version, held = self._version(), self.batches()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        files = files.select("path", "length", F.col("modificationTime").alias("modified"))
        known = self.inputs().select("path", F.col("length").alias("l"), F.col("modified").alias("m"))
        found = files.join(known, "path", "left").where("l is null or l <> length or m <> modified")
        rows = found.collect()
        changed = [r["path"] for r in rows if r["l"] is not None]
        if changed:
            raise ValueError(f"changed after they were counted: {', '.join(sorted(changed)[:5])}")
        if not rows:
            return 0
        new = self.spark.createDataFrame([(r["path"], r["length"], r["modified"]) for r in rows], _INPUTS)
        docs = read_corpus(self.spark, [r["path"] for r in rows], **self.options)
        if self.unified:
            docs = unify(docs, case=True, digits=True)
        self._commit(version, held, corpus_ngrams(docs, self.max_len), new)
        return len(rows)

    def _commit(self, version: int, held: list[str], words: DataFrame, inputs: DataFrame) -> None:
        batch = f"batch-{uuid.uuid4().hex}"
        try:
            words.write.parquet(f"{self.path}/{batch}/words")
            inputs.write.parquet(f"{self.path}/{batch}/inputs")
            self._publish(f"manifest-{version + 1:08d}", [*held, batch])
        except BaseException:
            delete(self.spark, f"{self.path}/{batch}")
            raise

    def compact(self) -> None:
        """Merge all batches into one.  The old ones stay for those who still read them."""
        version, held = self._version(), self.batches()
        if len(held) > 1:
            self._commit(version, [], self.dictionary(), self.inputs())

    def clean(self) -> int:
        """Delete batches that no longer count and manifests of the past; how many batches went.

        Only when no other job reads or adds.
        """
        hadoop, fs = file_system(self.spark, self.path)
        keep = {*self.batches(), f"manifest-{self._version():08d}"}
        stale = [
            f.getPath()
            for kind in ("batch-*", "manifest-*")
            for f in fs.globStatus(hadoop(f"{self.path}/{kind}"))
            if f.getPath().getName() not in keep
        ]
        for p in stale:
            fs.delete(p, True)
        return sum(p.getName().startswith("batch-") for p in stale)

    # Results

    def dictionary(self) -> DataFrame:
        """``word, freq`` over all batches."""
        words = self._tables("words", _WORDS)
        return words.groupBy("word").agg(F.sum("freq").alias("freq"))

    def corpus_length(self) -> DataFrame:
        """One row ``(total)``: the characters of all clauses."""
        return length_from_grams(self._tables("words", _WORDS))
