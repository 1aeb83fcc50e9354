"""BM25 over any corpus table: fitting and scoring are joins and sums on terms.

Only postings of terms that some query has are joined; document lengths and the corpus size are one
aggregate. Only the queries' terms are collected or broadcast, and only while they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.evaluation import top_per
from graphloom.sources.storage import cut

K1, B = 1.5, 0.75
#: Up to so many different query terms are looked up in the documents as a list, and so many rows of query and term broadcast.
FEW_TERMS, FEW_ASKED = 20_000, 200_000


def whitespace_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "\\s+"), lambda t: t != "")


def fit(docs: DataFrame, doc: str, text: str, tokens=X.tokenize, per: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (keys, doc, term, tf, dl) and corpus statistics (keys, n_docs, avgdl). `per` names independent corpora.

    Documents without tokens count in n_docs and in the mean length, as length 0.
    """
    keys = per or []
    tokenised = docs.select(*keys, F.col(doc).alias("doc"), tokens(F.col(text)).alias("terms"))
    sized = tokenised.withColumn("dl", F.size("terms").cast("double"))
    stats = sized.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))
    postings = sized.select(*keys, "doc", "dl", F.explode("terms").alias("term")).groupBy(*keys, "doc", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("dl").alias("dl"))
    return postings, stats


def score(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, query_text: str, tokens=X.tokenize, k1: float = K1, b: float = B, per: list[str] | None = None) -> DataFrame:
    """keys, query, doc, score for every pair that shares a term; a repeated query term counts each time.

    Documents are read and tokenised once, into a stored table of their lengths and terms. While the queries have at
    most FEW_TERMS terms, it holds only those terms, and the terms' tables are broadcast: the documents' terms are dealt
    by document, and neither scoring nor a top-k per query moves pairs beyond the best of each task.
    """
    keys = per or []
    asked = cut(queries.select(*keys, F.col(query).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy(*keys, "query", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf")))
    words = asked.select("term").distinct().limit(FEW_TERMS + 1).collect()  # bounded
    few = len(words) <= FEW_TERMS and asked.count() <= FEW_ASKED
    hint = F.broadcast if few else lambda df: df
    sized = docs.select(*keys, F.col(doc).alias("doc"), tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms").cast("double"))
    if few:
        known = [w["term"] for w in words]
        sized = sized.withColumn("terms", F.filter("terms", lambda t: t.isin(known)) if known else F.filter("terms", lambda t: F.lit(False)))
    sized = cut(sized.repartition(*keys, "doc"))
    stats = sized.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))
    spread = sized.select(*keys, "doc", "dl", F.explode("terms").alias("term"))
    if few:  # the stored table's rows of one document are in one partition: counted there, by document
        spread = spread.repartition(*keys, "doc")
    postings = spread.groupBy(*keys, "doc", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("dl").alias("dl"))
    df = sized.select(*keys, F.explode(F.array_distinct("terms")).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    terms = asked.join(df, [*keys, "term"])
    terms = terms.join(stats, keys) if keys else terms.crossJoin(F.broadcast(stats))  # stats is one row
    terms = terms.select(*keys, "query", "term", "avgdl", (F.col("qtf") * F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(hint(cut(terms)), [*keys, "term"]).groupBy(*keys, "query", "doc").agg(F.sum(part).alias("score"))


def topk(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, query_text: str, k: int = 5, tokens=X.tokenize) -> DataFrame:
    """The k best documents of each query: query, doc, score (6 places), rank; ties by the smaller id."""
    rounded = score(docs, queries, doc, text, query, query_text, tokens).withColumn("score", F.round("score", 6))
    return top_per(rounded, ["query"], "score", "doc", k)


def importance(docs: DataFrame, doc: str, text: str, stop_words: list[str], most: int = 100) -> DataFrame:
    """Row sums of L2-normalised TF-IDF over the `most` frequent terms: smooth idf ln((1+n)/(1+df))+1. Ties by term."""
    tokenised = docs.select(F.col(doc).alias("doc"), F.explode(F.filter(X.tokenize(F.col(text)), lambda t: (F.length(t) > 1) & ~t.isin(stop_words))).alias("term"))
    tf = tokenised.groupBy("doc", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    terms = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).cast("double").alias("df")).orderBy(F.desc("total"), "term").limit(most)
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = tf.join(F.broadcast(terms), "term").crossJoin(F.broadcast(n))  # `most` rows and one row
    weighted = rows.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    sums = weighted.groupBy("doc").agg((F.sum("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("importance"))
    return docs.select(F.col(doc).alias("doc")).join(sums, "doc", "left").select("doc", F.coalesce("importance", F.lit(0.0)).alias("importance"))
