"""The corpus pipeline: five stages, each written and read again by the next.

A document passes if its language is recognised, if it has the smallest doc_id
of its group of near copies, and if it gives no benchmark item away; personal
data in it is masked; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmine.llm import decontaminate, jaccard, langid, packing, pii
from wordmine.llm.memory import small_batches
from wordmine.llm.queries import vocabulary
from wordmine.session import materialize, new_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those in no known language."""
    small_batches(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group, that with the smallest doc_id."""
    small_batches(spark)
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other values."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    small_batches(spark)
    return pii.mask(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    small_batches(spark)
    pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), added=True)
    return packing.pack(materialize(pieces))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Two stages apply models trained here and the last one a tokenizer, so SQL
#: cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a Parquet table."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def pipeline_queries() -> dict:
    return {"pipeline": run}


def pipeline_oracles() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
