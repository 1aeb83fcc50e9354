"""Evidence retrieval: strategies, fusion, diversity and chains, for many questions at once.

Tables carry q_id and, for candidates, span_id; text order breaks ties by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X
from graphloom.operators.evaluation import rrf, scaled, top_per


def content_overlap(question_tokens: Column, text_tokens: Column) -> Column:
    """Shared distinct tokens without stop words."""
    stops = F.array(*map(F.lit, L.STOP_WORDS))
    return F.size(F.array_intersect(F.array_except(question_tokens, stops), text_tokens))


def sentence_scores(rows: DataFrame) -> DataFrame:
    """Adds score = .45 cosine + .25 overlap ratio + .20 scaled BM25 + .10 PageRank. Columns: sem, overlap, q_terms, bm25, pagerank."""
    ratio = F.when(F.col("q_terms") > 0, F.col("overlap") / F.col("q_terms")).otherwise(0.0)
    return scaled(rows, ["bm25"], ["q_id"]).withColumn("score", 0.45 * F.col("sem") + 0.25 * ratio + 0.20 * F.col("bm25") + 0.10 * F.col("pagerank"))


def weighted_combine(rows: DataFrame, weights: tuple[float, float, float] = L.HYBRID_WEIGHTS) -> DataFrame:
    """Adds score: min-max scaled sem, lex and cent, weighted; a constant column scales to 0."""
    score = scaled(rows.withColumns({"_sem": F.col("sem"), "_lex": F.col("lex"), "_cent": F.col("cent")}), ["_sem", "_lex", "_cent"], ["q_id"])
    parts = [w * F.col(c) for w, c in zip(weights, ("_sem", "_lex", "_cent"), strict=True)]
    return score.withColumn("score", parts[0] + parts[1] + parts[2]).drop("_sem", "_lex", "_cent")


def hybrid(rows: DataFrame, k: int = 5) -> DataFrame:
    """The 2k best of each question. Columns: sem, lex, cent, overlap, sentence_overlap (boolean)."""
    boosted = F.col("sem") + F.least(F.lit(0.15), 0.03 * F.col("overlap")) + F.when(F.col("sentence_overlap"), 0.03).otherwise(0.0)
    return top_per(weighted_combine(rows.withColumn("sem", boosted)).withColumn("score", F.round("score", 6)), ["q_id"], "score", "span_id", 2 * k)


def traversal_scores(rows: DataFrame, k: int = 5) -> DataFrame:
    """cosine + .2 centrality + .1 if the text has a condition, exception or negation marker + min(.2, .04 overlap); the k best."""
    markers = [m for kind in ("condition", "exception", "negation") for m in L.DISCOURSE[kind]]
    bonus = F.when(X.contains_any(F.lower("text"), markers), 0.1).otherwise(0.0)
    score = F.col("sem") + 0.2 * F.col("cent") + bonus + F.least(F.lit(0.2), 0.04 * F.col("overlap"))
    return top_per(rows.withColumn("score", F.round(score, 6)), ["q_id"], "score", "span_id", k)


def expansions(top: DataFrame, questions: DataFrame, spans: int = 3, words: int = 4) -> DataFrame:
    """q_id, variant, query: the question, and it with the first new words of each of its best spans; equal variants once.

    top: q_id, rank, text; questions: q_id, question.
    """
    asked = questions.select("q_id", "question", X.tokenize(F.col("question")).alias("known"))
    rows = top.filter(F.col("rank") <= spans).select("q_id", "rank", "text").join(asked, "q_id")
    fresh = F.slice(F.filter(X.tokenize(F.col("text")), lambda t: (F.length(t) > 2) & ~F.array_contains(F.col("known"), t)), 1, words)
    grown = rows.withColumn("fresh", fresh).filter(F.size("fresh") > 0).select("q_id", F.col("rank").alias("variant"), F.concat_ws(" ", "question", F.array_join("fresh", " ")).alias("query"))
    every = questions.select("q_id", F.lit(0).alias("variant"), F.col("question").alias("query")).unionByName(grown)
    first = Window.partitionBy("q_id", X.normalize_text(F.col("query"))).orderBy("variant")
    return every.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def fuse_variants(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of the variants' lists (rank from 1): the k best spans of each question."""
    fused = rrf(ranked.withColumn("r", F.col("rank") - 1), ["q_id"], "span_id", "r")
    return top_per(fused, ["q_id"], "rrf", "span_id", k)


def kg_guided(mentions: DataFrame, kg_edges: DataFrame, question_entities: DataFrame, sims: DataFrame, k: int = 5) -> DataFrame:
    """The k spans most similar to the question among those that mention its entities or their direct neighbours.

    mentions: doc_id, span_id, name; question_entities: q_id, doc_id, name; sims: q_id, span_id, sem.
    """
    around = question_entities.join(kg_edges.select("doc_id", F.col("src").alias("name"), F.col("dst").alias("other")), ["doc_id", "name"]).select("q_id", "doc_id", F.col("other").alias("name"))
    back = question_entities.join(kg_edges.select("doc_id", F.col("dst").alias("name"), F.col("src").alias("other")), ["doc_id", "name"]).select("q_id", "doc_id", F.col("other").alias("name"))
    wanted = question_entities.select("q_id", "doc_id", "name").union(around).union(back).distinct()
    spans = wanted.join(mentions, ["doc_id", "name"]).groupBy("q_id", "span_id").agg(F.count_distinct("name").alias("entity_hits"))
    return top_per(spans.join(sims, ["q_id", "span_id"]).withColumn("score", F.round("sem", 6)), ["q_id"], "score", "span_id", k)


def votes(lists: dict[str, DataFrame]) -> DataFrame:
    """q_id, span_id and a flag in_<name> for each list that has the span: one union and one aggregate."""
    rows = None
    for name, df in lists.items():
        part = df.select("q_id", "span_id", F.lit(name).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("q_id", "span_id").agg(*(F.max(F.when(F.col("list") == n, 1.0).otherwise(0.0)).alias(f"in_{n}") for n in lists))


def final_scores(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the fused score. Columns: sem, bm25, overlap (ratio), sentence, cent, in_hybrid, in_traversal, in_expansion, in_kg, kg_hits.

    BM25 is scaled over the candidates of the question; the bonus is .05 a knowledge-graph hit, at most .15.
    """
    weights = weights or L.CORE_WEIGHTS
    ready = scaled(rows, ["bm25"], ["q_id"]).withColumn("kg_bonus", F.least(F.lit(0.15), 0.05 * F.col("kg_hits")))
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.col(name)
    return ready.withColumn("score", F.round(total, 6))


def relevant(score: Column, overlap: Column, sentence_score: Column) -> Column:
    """Whether a candidate stays: never with a score under .12; with a shared content word, a score of .40, or a score of .50 of its sentence."""
    return (score >= 0.12) & ((overlap >= 1) | (score >= 0.40) | (F.coalesce(sentence_score, F.lit(0.0)) >= 0.50))


def merge_sub_questions(rows: DataFrame) -> DataFrame:
    """q_id, span_id and the score summed over the question's parts."""
    return rows.groupBy("q_id", "span_id").agg(F.sum("score").alias("score"))


def merge_entities(chains: DataFrame) -> DataFrame:
    """q_id and the knowledge-graph entities on the chains of all its parts, each once, sorted."""
    on_graph = chains.filter("type = 'kg_bridge'").select("q_id", F.explode("nodes").alias("entity"))
    return on_graph.groupBy("q_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def merge_chains(chains: DataFrame, k: int = 3) -> DataFrame:
    """Chains with one text once, the best first; the k best of each question."""
    once = Window.partitionBy("q_id", "text").orderBy(F.desc("score"))
    unique = chains.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    return top_per(unique, ["q_id"], "score", "text", k)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=-1), np.linalg.norm(b, axis=-1)
    size = na[:, None] * nb[None, :]
    return np.where(size > 0, a @ b.T / np.where(size > 0, size, 1), 0.0)


def mmr(rows: DataFrame, k: int, trade: float = 0.65) -> DataFrame:
    """Maximal marginal relevance: q_id, span_id, pick (from 1). Columns: q_id, span_id, score, embedding, in list order `rank`.

    Selection is sequential within a question, so it runs as one group a question; lists of k or fewer come back as they are.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = list(range(len(pdf)))
        if len(pdf) > k:
            v = np.array(pdf["embedding"].to_list(), float)
            sims, score, order = _cosines(v, v), pdf["score"].to_numpy(), []
            while len(order) < k:
                penalty = sims[:, order].max(1) if order else np.zeros(len(pdf))
                value = trade * score - (1 - trade) * penalty
                value[order] = -np.inf
                order.append(int(value.argmax()))
        return pd.DataFrame({"q_id": pdf["q_id"].iloc[order].to_numpy(), "span_id": pdf["span_id"].iloc[order].to_numpy(), "pick": np.arange(1, len(order) + 1)})

    kinds = dict(rows.dtypes)
    return rows.select("q_id", "span_id", "rank", "score", "embedding").groupBy("q_id").applyInPandas(run, f"q_id {kinds['q_id']}, span_id {kinds['span_id']}, pick int")


def diverse(rows: DataFrame, most: int = 5, trade: float = 0.6) -> DataFrame:
    """Diverse evidence: similarity to the centroid of the first 2 * most embeddings against similarity to the picked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = list(range(len(pdf)))
        if len(pdf) > most:
            v = np.array(pdf["embedding"].to_list(), float)
            near, sims, order = _cosines(v, v[: 2 * most].mean(0, keepdims=True))[:, 0], _cosines(v, v), []
            while len(order) < most:
                value = trade * near - (1 - trade) * (sims[:, order].max(1) if order else 0)
                value[order] = -np.inf
                order.append(int(value.argmax()))
        return pd.DataFrame({"q_id": pdf["q_id"].iloc[order].to_numpy(), "span_id": pdf["span_id"].iloc[order].to_numpy(), "pick": np.arange(1, len(order) + 1)})

    kinds = dict(rows.dtypes)
    return rows.select("q_id", "span_id", "rank", "embedding").groupBy("q_id").applyInPandas(run, f"q_id {kinds['q_id']}, span_id {kinds['span_id']}, pick int")


def diverse_by_section(rows: DataFrame, most: int = 5) -> DataFrame:
    """Without embeddings: the first of each section, then the rest in order. Columns: q_id, span_id, section, rank."""
    of_section = Window.partitionBy("q_id", "section").orderBy("rank")
    tagged = rows.withColumn("again", (F.row_number().over(of_section) > 1).cast("int"))
    order = Window.partitionBy("q_id").orderBy("again", "rank")
    return tagged.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= most).drop("again")


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """q_id, span_id, pos: the lists one after the other, a span at its first place. Each has q_id, span_id, rank."""
    rows = None
    for n, df in enumerate(lists):
        part = df.select("q_id", "span_id", F.lit(n).alias("list"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("q_id", "span_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    return first.select("q_id", "span_id", F.row_number().over(Window.partitionBy("q_id").orderBy("at", "span_id")).alias("pos"))


def path_chains(paths: DataFrame, sentences: DataFrame, shortest: int = 2, longest: int = 4) -> DataFrame:
    """Evidence chains from weighted paths of 2 to 4 sentences: the joined texts and the mean PageRank. paths: q_id, doc_id, nodes."""
    kept = paths.filter(F.size("nodes").between(shortest, longest)).select("q_id", "doc_id", "nodes", F.posexplode("nodes").alias("pos", "node_id"))
    rows = kept.join(sentences.select("doc_id", "node_id", "text", "pagerank"), ["doc_id", "node_id"])
    lists = rows.groupBy("q_id", "doc_id", "nodes").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"), F.avg("pagerank").alias("score"))
    return lists.select("q_id", F.lit("drg_path").alias("type"), "nodes", F.array_join(F.transform("l", lambda s: s["text"]), " -> ").alias("text"), "score")


def kg_chains(question_entities: DataFrame, sentence_entities: DataFrame, kg_edges: DataFrame) -> DataFrame:
    """Chains from a question's entity to a sentence's over at most two edges, of score .5 / nodes; two joins find every path."""
    one = kg_edges.select("doc_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = sentence_entities.select("q_id", "doc_id", F.col("name").alias("z")).distinct()
    starts = question_entities.select("q_id", "doc_id", F.col("name").alias("a")).distinct()
    direct = starts.join(one, ["doc_id", "a"]).join(ends.withColumnRenamed("z", "b"), ["q_id", "doc_id", "b"]).select("q_id", "doc_id", F.array("a", "b").alias("nodes"))
    second = one.select("doc_id", F.col("a").alias("b"), F.col("b").alias("z"))
    through = starts.join(one, ["doc_id", "a"]).join(second, ["doc_id", "b"]).join(ends, ["q_id", "doc_id", "z"]).filter("a <> z").select("q_id", "doc_id", F.array("a", "b", "z").alias("nodes"))
    near = direct.select("q_id", "doc_id", F.get("nodes", F.lit(0)).alias("a"), F.element_at("nodes", -1).alias("z"))
    far = through.withColumns({"a": F.get("nodes", F.lit(0)), "z": F.element_at("nodes", -1)}).join(near, ["q_id", "doc_id", "a", "z"], "left_anti").groupBy("q_id", "doc_id", "a", "z").agg(F.min("nodes").alias("nodes")).select("q_id", "doc_id", "nodes")
    both = direct.unionByName(far)
    return both.select("q_id", F.lit("kg_bridge").alias("type"), "nodes", F.array_join("nodes", " -> ").alias("text"), (0.5 / F.size("nodes")).alias("score"))
