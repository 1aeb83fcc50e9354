"""The queries of the corpus operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import audio_prints, hamming_search, language_id, mixing, near_dedup, piece_codec, pseudo_likelihood, quality, secret_scan, token_counts
from graphloom.llm.common import bucket_of_id

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(_table(spark, sf_dir, "documents"), PIECES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train_on(docs, 3, 1))
    return found.select("doc_id", (bucket_of_id("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, _table(spark, sf_dir, "labels"), bucket_of_id("doc_id", 5) != 0)
    return quality.score_quality(docs, model).select("doc_id", (bucket_of_id("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_table(spark, sf_dir, "documents"))


def op5_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    codes = vectors.select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.search(codes, codes.filter(F.col("id") % 20 == 0), 10)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), PIECES, token_counts.fresh_cache(spark))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


def op8_audio_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has audio: recordings are rendered from vectors, and noisy excerpts of every 20th are searched for."""
    vectors = _table(spark, sf_dir, "embeddings")
    media = audio_prints.render_tones(vectors)
    clips = audio_prints.render_tones(vectors.filter(F.col("vec_id") % 20 == 0), skip=10 * audio_prints.HOP, noise=0.01)
    return audio_prints.match_classes(audio_prints.fingerprints(media), audio_prints.fingerprints(clips))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_components(_table(spark, sf_dir, "documents"), 85, 3)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).withColumn("prob", F.round("prob", 9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_quality, op4_secret_scan, op5_hamming_search, op6_token_counts, op7_pseudo_likelihood, op8_audio_prints, op9_near_dedup, op10_mixing)}
ORACLES: dict[str, str] = {"op5_hamming_search": hamming_search.oracle_sql(), "op9_near_dedup": near_dedup.oracle_sql(), "op10_mixing": mixing.oracle_sql()}
