"""A training-corpus pipeline: language ID, near-dedup, secret masking, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder
and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language_id, mixing, near_dedup, piece_codec, secret_scan
from graphloom.llm.common import remove, scratch
from graphloom.llm.registry import PIECES

#: The near-duplicate stage: words a shingle and percent of similarity.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on the stage's own labelled rows, doesn't reject; null texts and texts without letters are rejected."""
    return language_id.keep_identified(docs, language_id.train_on(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each near-duplicate group; rows without an id and repeats of a kept id stay."""
    return near_dedup.keep_one_each(docs, SIMILAR_PERCENT, SHINGLE_WORDS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret masked; n_chars follows the text, null for null texts."""
    return secret_scan.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target source, language and topic weights; null sources and languages are values of their own."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with an end id, and digests of the ids and of the text that they decode to; null texts are empty."""
    return piece_codec.encode_digests(docs, PIECES, with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Trained models, signatures and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; a stage's table is deleted once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
