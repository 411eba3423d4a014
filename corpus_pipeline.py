"""The corpus pipeline: five stages, each an operator of terraloom.llm on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import exact_dedup, language_id, mixing, pieces, simhash
from terraloom.llm._common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (10): documents whose language can't be told (no letters) go."""
    return language_id.keep_known(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (2): of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (8): of texts linked by a similarity of 0.8 or more in five-word shingles the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (6): documents sampled by their calibrated probabilities stay."""
    return mixing.draw(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (9): the digests of ids and of the decoded text."""
    return pieces.encode_texts(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [("language ID", language), ("exact dedup", copies), ("SimHash near-dedup", near_copies), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", tokens)]

#: Language models, fitting and encoding aren't SQL: tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
