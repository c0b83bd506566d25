"""A corpus pipeline: language, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trelliq.llm import byte_bpe, exact_dedup, language, mixing, simhash
from trelliq.llm.common import clear, scratch, scratch_run


# Stages take extra columns of any name along and leave an empty table empty.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a recognisable language: null and empty texts and those without letters go, rows with null doc_id or lang stay."""
    return language.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: the one with the largest doc_id, of repeated rows one."""
    return exact_dedup.keep_first_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints: the one with the smallest doc_id, of repeated rows one."""
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it; null is a source, ties fall by doc_id, and texts without words go."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null text counts as empty, repeated rows and null doc_ids stay."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned, streamed and iterative stages are not SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. Scratch tables go as soon as a stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_run():
        for name, stage in STAGES:
            path = scratch(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            clear(spark, keep=(path,))
    return docs
