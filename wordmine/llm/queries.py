"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordmine.llm import (
    decontaminate,
    idfiles,
    jaccard,
    langid,
    merkle,
    ngramllr,
    packing,
    pii,
    quality,
    sharding,
    tokens,
    trie,
    urls,
    warc,
)
from wordmine.session import materialize, new_folder

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A tokenizer file; the folder can be set by WORDMINE_TOKENIZERS."""
    folder = os.environ.get("WORDMINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_best_fit_packing(spark, sf):
    path = vocabulary("word_bpe_49k.json")
    pieces = packing.token_pieces(table(spark, sf, "documents"), path, added=True, remember=160 << 20)
    return packing.pack(materialize(pieces))


@query
def op10_token_id_files(spark, sf):
    path = vocabulary("byte_bpe_50k.json")
    ids = tokens.token_ids(table(spark, sf, "documents"), path, added=True, remember=160 << 20)
    ids = materialize(ids, compression="zstd")
    out = new_folder(spark, "ids")
    idfiles.write_ids(ids, out, tokens.id_type(path).str)
    return idfiles.read_ids(spark, out, digest=True)


@query
def op1_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op6_ngram_jaccard_join(spark, sf):
    return jaccard.near_duplicate_groups(table(spark, sf, "documents"))


@query
def op5_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return langid.predictions(docs, langid.fit(docs))


@query
def op2_personal_data(spark, sf):
    docs = table(spark, sf, "documents")
    return pii.find(docs, pii.fit(docs))


@query
def op4_ordinal_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.grade(docs, quality.fit(docs, quality.grades_of(table(spark, sf, "labels"))))


@query
def op7_url_trees(spark, sf):
    pages = table(spark, sf, "pages")
    return urls.judge(pages, urls.UrlModel(urls.labelled_by_rules(pages)))


@query
def op8_sampled_splitters(spark, sf):
    return sharding.shard(table(spark, sf, "documents"))


@query
def op9_ngram_ratio_rules(spark, sf):
    docs = table(spark, sf, "documents")
    weights = ngramllr.bucket_weights(docs, ngramllr.trusted_ids(table(spark, sf, "labels")))
    return ngramllr.judged(docs, materialize(weights))


@query
def op11_conversation_trie(spark, sf):
    return trie.prefix_trie(table(spark, sf, "conversations"))


@query
def op12_merkle_manifest(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"))


@query
def op13_warc_archives(spark, sf):
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    index = warc.capture_index(spark, path)
    return index.drop("part", "offset")
