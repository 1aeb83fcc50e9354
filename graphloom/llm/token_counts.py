"""Token counts through a digest cache.

Each text's content (null counts as empty; this tokenizer's own normalisation is the identity, so nothing
else may be changed without changing counts) is named by its SHA-256, computed on the JVM, and the tokenizer
by the SHA-256 of its model file. Digests that the cache lacks are reduced to one document each, only those
texts go to the tokenizer, and their counts are appended to the cache: a Parquet table of (version, digest,
n_tokens), partitioned by version. Every document then gets its count by joining digests, so texts move once
at most and only for misses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, scratch, stored

CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


_LOADED: dict = {}


def counter(path: str):
    """A function from texts to counts, by the library that the file is for; loaded once per worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The cache's rows of one tokenizer version; no rows where nothing is stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(path).filter(F.col("version") == version).select("digest", "n_tokens")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes of UTF-8, n_tokens, over_limit (n_tokens > limit).

    Null text counts as the empty text: 0 bytes, 0 tokens. Null and repeated ids pass through; equal texts are
    encoded once. Other columns are ignored; an empty table gives an empty table and leaves the cache as it is.
    """
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = stored(named.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    missing = digests.join(read_cache(spark, cache_path, version), "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    one_each = named.alias("d").join(missing.alias("m"), (F.col("d.digest") == F.col("m.digest")) & F.col("d.doc_id").eqNullSafe(F.col("m.first_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    # an id given twice with one text passes the semi-join twice; the maximum keeps one row
    counted = one_each.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache_path)
    # stored first: between two plain tables Spark splits the rows of a hot digest
    known = stored(read_cache(spark, cache_path, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return digests.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A path for a cache of one run, in the shared folder."""
    return scratch(spark, "token-counts")
