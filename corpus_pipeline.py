"""A training corpus from ``documents``: reject by quality, one of each group of near copies, surrogates for personal
data, a mix by source weights, token ids.

Stages take and return the columns of their input, whatever these are called, but for the last one.  Null texts count
as empty, null ids and sources are values like others, repeated rows are rows of their own (near copies of each other
in the second stage), texts may be of any length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, mixing, ngram_join, pii, quality
from lorekeep.llm.common import discard, free_name, materialize, table

#: SQL has no trees, surrogates or byte-pair merges: the pipeline is tested against its parts.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a model of the quality labels scores at 0.5 or more; equal texts share one fate."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words or without an id stay, unless they are near copies."""
    return ngram_join.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and secrets in their texts replaced by surrogates; null texts stay null."""
    count = free_name(docs, "n_entities")
    return pii.pseudonymize(docs, pii.configured_key(spark) or pii.SAMPLE_KEY, count=count).drop(count)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix by source weights takes it; rows without words never."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of tokens, and digests of the ids and of the decoded text of each row."""
    return bpe.encode_decode(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read goes once its result is a table."""
    docs, read = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i + 1}")
            if read:
                discard(*read)
            read = [docs]
    return docs
