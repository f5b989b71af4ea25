"""From raw documents to packed training sequences.

Language identification, near-duplicate removal, redaction of personal data, mixing of the
sources and packing, each on all that the stage before has kept. Every stage is written as
Parquet and read again, so a lost executor repeats one stage at most. Stages keep all columns
of `documents` but the last, which returns pieces: doc_id, start, length, ids_crc32,
doc_tokens, sequence_id, offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import jaccard, language, mixing, packing, private
from codeloom.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null or have no letter go."""
    return language.keep_known(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return jaccard.keep_one(docs, size=5, percent=80)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return private.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to twice."""
    return mixing.mix(docs).select("row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in windows."""
    return packing.pack(docs, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", distinct_documents),
    ("private_data", without_private_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# No stage can be written as SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
