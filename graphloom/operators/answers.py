"""Answer selection from ranked evidence, with a pluggable reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.bm25 import score as bm25_score


def answer_score(score: Column, is_sentence: Column, overlap: Column, query_terms: Column, length: Column, most: int) -> Column:
    """The retrieval score adjusted for sentence form, overlap and length."""
    ratio = F.when(query_terms > 0, overlap / query_terms).otherwise(0.0)
    out = score + F.when(is_sentence, 0.08).otherwise(0.0) + 0.2 * ratio
    out = out + F.when(overlap >= 2, 0.08).when(overlap == 0, -0.12).otherwise(0.0)
    return out - F.when(length > 1.6 * most, 0.08).otherwise(0.0) - 0.0003 * F.least(length, F.lit(600))


def rank_answers(rows: DataFrame, most: int = 220, candidates: int = 40, per_sentence: int = 2) -> DataFrame:
    """The first candidates ranked: q_id, span_id, sentence_id, text, answer_score, rank.

    Columns: q_id, span_id, sentence_id, text, span_type, score, pos, query (tokens). Two spans a sentence at most,
    unless fewer than three would be left.
    """
    tokens = X.tokenize(F.col("text"))
    rows = rows.filter(F.col("pos") <= candidates).withColumn("overlap", X.fuzzy_overlap(F.col("query"), tokens))
    adjusted = answer_score(F.col("score"), F.col("span_type") == "sentence", F.col("overlap"), F.size("query"), F.length("text"), most)
    rows = rows.withColumn("answer_score", F.round(adjusted, 6))
    of_sentence = Window.partitionBy("q_id", "sentence_id").orderBy(F.desc("answer_score"), "pos")
    numbered = rows.withColumn("n", F.row_number().over(of_sentence))
    left = F.sum((F.col("n") <= per_sentence).cast("int")).over(Window.partitionBy("q_id"))
    kept = numbered.withColumn("left", left).filter((F.col("n") <= per_sentence) | (F.col("left") < 3))
    order = Window.partitionBy("q_id").orderBy(F.desc("answer_score"), "pos")
    return kept.withColumn("rank", F.row_number().over(order)).drop("n", "left")


def fallback_sentences(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Where the best overlap of a question is 0: the sentence with the most overlap less .0003 a character up to 600.

    rows: q_id, overlap, query, doc_id; sentences: doc_id, node_id, text.
    """
    missed = rows.groupBy("q_id").agg(F.max("overlap").alias("best"), F.first("query").alias("query"), F.first("doc_id").alias("doc_id")).filter("best = 0")
    pool = missed.join(sentences.select("doc_id", "node_id", "text"), "doc_id")
    value = X.fuzzy_overlap(F.col("query"), X.tokenize(F.col("text"))) - 0.0003 * F.least(F.length("text"), F.lit(600))
    return pool.groupBy("q_id").agg(F.max_by(F.struct("node_id", "text"), F.struct(value, -F.col("node_id"))).alias("s")).select("q_id", "s.node_id", "s.text")


def promote(answers: DataFrame, sentences: DataFrame, most: int = 220) -> DataFrame:
    """A non-sentence answer becomes its sentence if that has at most 1.2 * most characters."""
    parent = sentences.select("doc_id", F.col("node_id").alias("sentence_id"), F.col("text").alias("parent"))
    joined = answers.join(parent, ["doc_id", "sentence_id"], "left")
    fits = (F.col("span_type") != "sentence") & (F.length("parent") > 0) & (F.length("parent") <= 1.2 * most)
    return joined.withColumn("text", F.when(fits, F.col("parent")).otherwise(F.col("text"))).drop("parent")


def reorder_contexts(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, pos, text, score, place: the context of the best BM25 moves to the front if it isn't there, scores above 0, and the first scores 0 or less than 1/1.5 of it.

    contexts: q_id, pos, text; questions: q_id, question. Each question's contexts are a corpus of their own.
    """
    scored = bm25_score(contexts, questions, "pos", "text", "q_id", "question", per=["q_id"])
    joined = contexts.select("q_id", "pos", "text").join(scored.select("q_id", F.col("doc").alias("pos"), "score"), ["q_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("q_id")
    best = F.max(F.struct(F.col("score").alias("s"), (-F.col("pos")).alias("p"))).over(w)
    first = F.min(F.struct(F.col("pos").alias("p"), F.col("score").alias("s"))).over(w)
    tagged = joined.withColumns({"best": best, "first": first})
    top = -F.col("best.p")
    move = (top != F.col("first.p")) & (F.col("best.s") > 0) & ((F.col("first.s") == 0) | (F.col("best.s") > 1.5 * F.col("first.s")))
    tagged = tagged.withColumn("front", F.when(move & (F.col("pos") == top), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("front", "pos"))
    return tagged.select("q_id", "pos", "text", "score", place.alias("place"))


def qa_contexts(contexts: DataFrame, merged: int = 5, characters: int = 350) -> DataFrame:
    """The reader's inputs in three passes: each context, the first ones merged and cut, and the best sentences alone and in pairs.

    contexts: q_id, place, text, sentences (array of the best BM25 sentences). Returns q_id, pass, ord, context.
    """
    one = contexts.select("q_id", F.lit(1).alias("pass"), F.col("place").alias("ord"), F.col("text").alias("context"))
    cut = contexts.filter(F.col("place") <= merged).groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, characters).alias("t")))), lambda s: s["t"]), " ").alias("context"))
    two = cut.select("q_id", F.lit(2).alias("pass"), F.lit(1).alias("ord"), "context")
    best = contexts.filter("place = 1").select("q_id", F.posexplode(F.slice("sentences", 1, 8)).alias("ord", "context"))
    three = best.select("q_id", F.lit(3).alias("pass"), "ord", "context")
    return one.unionByName(two).unionByName(three)


def accept_reading(read: DataFrame, accept: float = 0.05, second: float = 0.35, third: float = 0.50, first_margin: float = 0.20, last_margin: float = 0.05) -> DataFrame:
    """q_id, answer, qa_score by folding the passes in order.

    In pass 1 a later context replaces the answer only by `first_margin`; pass 2 counts while the score is below
    `second`, pass 3 while below `third` and only by `last_margin`. Readings under `accept` don't count.
    read: q_id, pass, ord, answer, qa_score.
    """
    usable = read.filter((F.col("qa_score") >= accept) & (F.length(F.trim("answer")) > 0))
    lists = usable.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("pass", "ord", F.col("qa_score").cast("double").alias("qa_score"), "answer"))).alias("l"))
    start = F.struct(F.lit("").alias("answer"), F.lit(0.0).cast("double").alias("qa_score"))

    def fold(got, r):
        better = (
            F.when(got["qa_score"] == 0, F.lit(True))
            .when(r["pass"] == 1, r["qa_score"] > got["qa_score"] + first_margin)
            .when(r["pass"] == 2, (got["qa_score"] < second) & (r["qa_score"] > got["qa_score"]))
            .otherwise((got["qa_score"] < third) & (r["qa_score"] > got["qa_score"] + last_margin))
        )
        return F.when(better, F.struct(r["answer"].alias("answer"), r["qa_score"].alias("qa_score"))).otherwise(got)

    return lists.select("q_id", F.aggregate("l", start, fold).alias("a")).select("q_id", "a.answer", "a.qa_score")


def keep_evidence(ranked: DataFrame, top: int = 10, most: int = 3) -> DataFrame:
    """Of a question's first ten answers those with overlap or at least 60 % of the best score, three at most."""
    best = F.max("answer_score").over(Window.partitionBy("q_id"))
    rows = ranked.filter(F.col("rank") <= top).withColumn("best", best).filter((F.col("answer_score") >= 0.6 * F.col("best")) | (F.col("overlap") >= 1))
    order = Window.partitionBy("q_id").orderBy("rank")
    return rows.withColumn("evidence_rank", F.row_number().over(order)).filter(F.col("evidence_rank") <= most).drop("best")


def entity_evidence(spans: DataFrame, pages: DataFrame, facts: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """q_id, entity, texts: up to `most` span texts with the entity, pages filling up, then the entity's facts.

    spans: q_id, ord, text; pages: q_id, ord, text; facts: q_id, entity, facts; entities: q_id, entity.
    """
    hit = lambda df, source: entities.join(df, "q_id").filter(F.contains(F.lower("text"), F.lower("entity"))).select("q_id", "entity", F.lit(source).alias("source"), "ord", "text")
    both = hit(spans, 0).unionByName(hit(pages, 1))
    w = Window.partitionBy("q_id", "entity").orderBy("source", "ord")
    lists = both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).groupBy("q_id", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]).alias("texts"))
    joined = entities.select("q_id", "entity").distinct().join(lists, ["q_id", "entity"], "left").join(facts, ["q_id", "entity"], "left")
    none = F.array().cast("array<string>")
    return joined.select("q_id", "entity", F.concat(F.coalesce("texts", none), F.coalesce("facts", none)).alias("texts"))
