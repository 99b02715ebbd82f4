"""A dictionary stored for lookups, in buckets of what it is looked up by.

Every lookup of the word statistics asks by a stem or by a part of a word.  An index
keeps the dictionary in tables that are dealt to buckets by just that, so a job that
reads them joins and groups bucket by bucket, without moving a row.  The rows are
moved once, when the index is built; it pays when several lookups, or several runs
with other limits, follow.

An index is a folder with the tables ``words``, ``right``, ``left`` and ``parts``, and
``index``, written last, that tells the number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmine.operators import cohesion as coh
from wordmine.operators import freedom as fr
from wordmine.session import file_system

_TABLES = {
    "words": ("word", "word string, freq bigint"),
    "right": ("word", "word string, extension string, extension_freq bigint"),
    "left": ("word", "word string, extension string, extension_freq bigint"),
    "parts": ("part", "word string, freq bigint, k int, side string, part string"),
}


class DictionaryIndex:
    """An index at ``path``, as ``build_index`` has written it.

    The tables are known to the session only while the index is open; ``close`` (or
    the end of a ``with`` block) forgets them and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop, fs = file_system(spark, self.path)
        if not fs.exists(hadoop(f"{self.path}/index/_SUCCESS")):
            raise FileNotFoundError(f"{path} holds no complete index")
        row = spark.read.schema("buckets int").parquet(f"{self.path}/index").first()
        self.buckets = row["buckets"]
        own = uuid.uuid4().hex
        self._names = {name: f"wordmine_{name}_{own}" for name in _TABLES}
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        for name, (key, schema) in _TABLES.items():
            spark.sql(
                f"CREATE TABLE {self._names[name]} ({schema}) USING parquet "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{place}/{name}'"
            )

    def __enter__(self) -> DictionaryIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._names[name])

    def words(self) -> DataFrame:
        """The dictionary, ``word, freq``."""
        return self.table("words")

    def extensions(self, words: DataFrame, side: str = "right") -> DataFrame:
        """As ``operators.freedom.extensions``; no row moves if ``words`` come from ``words()``."""
        return words.select("word").join(self.table(side), "word")

    def freedom(self, candidates: DataFrame) -> DataFrame:
        """As ``operators.freedom.freedom``, under the same condition."""
        return fr.freedom_of(candidates, lambda side: self.extensions(candidates, side))

    def part_freq(self, words: DataFrame) -> DataFrame:
        """As ``lookup_freq`` of the ``parts`` of ``words``.

        ``words`` are the words that were indexed with their parts; the longer parts
        come from the index.  Single characters are parts of very many words, so
        these are cut off again here and their small table is broadcast.
        """
        both = coh.parts(words)
        single = coh.lookup_unigram(both.where(F.length("part") == 1), self.words(), "part")
        longer = self.words().where(F.length("word") > 1).select(
            F.col("word").alias("part"), F.col("freq").alias("part_freq")
        )
        found = self.table("parts").join(longer, "part").select(single.columns)
        return single.unionByName(found)

    def cohesion(
        self, words: DataFrame, total: Column, max_len: int, cap: float | None = None
    ) -> DataFrame:
        """As ``operators.cohesion.cohesion``, of the words that were indexed with their
        parts; the rows move once, to the words."""
        return coh.cohesion(words, self.words(), total, max_len, cap, lookup=self.part_freq)


def build_index(
    grams: DataFrame, words: DataFrame, path: str, buckets: int | None = None
) -> DictionaryIndex:
    """Write the dictionary ``grams``, and the parts of ``words``, to ``path`` and open it.

    ``grams`` is read three times and ``words`` once, so they should be stored tables.
    Without ``buckets`` there are as many as shuffles have partitions.  Writing runs a
    job per table.  A stem has at most one row per character of the alphabet, and
    parts of one character are not stored, so no bucket gets hot.  A folder that
    holds an index is refused; one that a failed job left is written again.
    """
    spark, path = grams.sparkSession, path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hadoop, fs = file_system(spark, path)
    if fs.exists(hadoop(f"{path}/index/_SUCCESS")):
        raise FileExistsError(f"{path} holds an index")
    plain = grams.select("word", "freq")
    tables = {
        "words": plain,
        "right": fr.stems(plain, "right"),
        "left": fr.stems(plain, "left"),
        "parts": coh.parts(words.select("word", "freq")).where(F.length("part") > 1),
    }
    for name, df in tables.items():
        key = _TABLES[name][0]
        table = f"wordmine_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, key).write.format("parquet").mode("overwrite")
        writer.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
    made = spark.range(1).select(F.lit(buckets).cast("int").alias("buckets"))
    made.write.mode("overwrite").parquet(f"{path}/index")
    return DictionaryIndex(spark, path)
