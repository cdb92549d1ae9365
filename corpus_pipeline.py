"""A training corpus from `documents`: quality rules, near-dedup, personal data, mixing, SentencePiece.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import alike, mixing, pii, quality, sentencepiece_codec
from cohortspark.operators.graph import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.judge(docs).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    return alike.keep_one(docs, size=5, least=0.8).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.redact(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the target weights, none twice: copies have just been removed."""
    return mixing.mix(docs, share=0.8, max_epochs=1).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return sentencepiece_codec.encode(docs, keep_text=False).select("doc_id", "source", "lang", "n_tokens", "ids", "round_trip")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]
# Fingerprints are XXH64 sums, and piece ids come from a model file: not SQL. Tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
