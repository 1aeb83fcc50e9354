"""Pages to sentences to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X

GLOBAL = "GLOBAL"


def page_sections(pages: DataFrame) -> DataFrame:
    """doc_id, page, section: the last heading line of the page, carried forward from earlier pages; GLOBAL before any."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\\n")).alias("line", "content"))
    own = lines.select("doc_id", "page", "line", X.section_title(F.col("content")).alias("title")).groupBy("doc_id", "page").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("line"))).alias("title"))
    forward = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("doc_id", "page", F.coalesce(F.last("title", ignorenulls=True).over(forward), F.lit(GLOBAL)).alias("section"))


def sentence_nodes(pages: DataFrame) -> DataFrame:
    """doc_id, node_id (from 0 over the document), text, page, section, sent_index (from 0 on each page)."""
    split = pages.select("doc_id", "page", F.posexplode(X.sentences(F.col("text"))).alias("sent_index", "text"))
    placed = split.join(page_sections(pages), ["doc_id", "page"], "left")
    order = Window.partitionBy("doc_id").orderBy("page", "sent_index")
    return placed.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("node_id"), "text", "page", F.coalesce("section", F.lit(GLOBAL)).alias("section"), "sent_index")


def keep_apart(found: Column) -> Column:
    """Of an ordered array of structs with start and end, each that overlaps none kept before it."""
    empty = F.filter(found, lambda s: F.lit(False))
    return F.aggregate(found, empty, lambda got, s: F.when(F.exists(got, lambda g: (g["start"] < s["end"]) & (s["start"] < g["end"])), got).otherwise(F.concat(got, F.array(s))))


def clause_spans(sentence: Column, long_sentence: int = 150, long_clause: int = 30) -> Column:
    """Clauses over `long_clause` characters of a sentence over `long_sentence`, with running offsets that leave out the separators."""
    parts = X.clauses(sentence)
    placed = F.transform(parts, lambda c, i: F.struct(F.lit("clause").alias("span_type"), c.alias("text"), F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, p: s + F.length(p)).alias("start")))
    ended = F.transform(placed, lambda s: F.struct(s["span_type"].alias("span_type"), s["text"].alias("text"), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end")))
    keep = F.filter(ended, lambda s: F.length(s["text"]) > long_clause)
    return F.when((F.length(sentence) > long_sentence) & (F.size(parts) > 1), keep).otherwise(F.filter(ended, lambda s: F.lit(False)))


def span_rows(sentences: DataFrame, per_sentence_entities: DataFrame | None = None) -> DataFrame:
    """Sentence spans, entity spans and clauses in that order, overlaps with earlier entity spans dropped.

    per_sentence_entities has doc_id, node_id, ord, text, label; a model's recogniser can supply it. The key is
    (doc_id, sentence_id, ord). Repeats of a text within a sentence keep the first.
    """
    base = sentences.select("doc_id", F.col("node_id").alias("sentence_id"), "text", "page", "section")
    whole = base.select("doc_id", "sentence_id", F.lit(0).alias("family"), F.lit(0).alias("pos"), F.lit("sentence").alias("span_type"), "text", F.lit(0).alias("start"), F.length("text").alias("end"))
    clauses = base.select("doc_id", "sentence_id", F.lit(2).alias("family"), F.posexplode(clause_spans(F.col("text"))).alias("pos", "s")).select("doc_id", "sentence_id", "family", "pos", "s.span_type", "s.text", "s.start", "s.end")
    rows = whole
    if per_sentence_entities is not None:
        named = per_sentence_entities.select("doc_id", F.col("node_id").alias("sentence_id"), F.col("ord").alias("pos"), F.trim(F.col("text")).alias("name"), "label")
        found = named.join(base.select("doc_id", "sentence_id", "text"), ["doc_id", "sentence_id"]).withColumn("start", F.expr("locate(name, text) - 1"))
        kept = found.filter((F.col("start") >= 0) & (F.length("name") >= 2) & F.col("name").rlike("[\\p{L}\\p{N}]"))
        lists = kept.groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("ner:"), "label").alias("span_type"), F.col("name").alias("text"), "start", (F.col("start") + F.length("name")).alias("end")))).alias("l"))
        apart = lists.select("doc_id", "sentence_id", F.explode(keep_apart(F.col("l"))).alias("s"))
        rows = rows.unionByName(apart.select("doc_id", "sentence_id", F.lit(1).alias("family"), "s.pos", "s.span_type", "s.text", "s.start", "s.end"))
    rows = rows.unionByName(clauses)
    first = Window.partitionBy("doc_id", "sentence_id", F.lower(F.trim("text"))).orderBy("family", "pos")
    once = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    order = Window.partitionBy("doc_id", "sentence_id").orderBy("family", "pos")
    placed = once.withColumn("ord", F.row_number().over(order) - 1)
    return placed.join(base.select("doc_id", "sentence_id", "page", "section"), ["doc_id", "sentence_id"]).select("doc_id", "sentence_id", "ord", "text", "span_type", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "page", "section")


def with_entities(rows: DataFrame, text: str = "text", ignore_case: bool = True) -> DataFrame:
    """Adds the pattern entities of each row's text."""
    return rows.withColumn("entities", X.pattern_entities(F.col(text), ignore_case))


def sentence_entity_sets(spans: DataFrame) -> DataFrame:
    """doc_id, sentence_id and the sorted distinct texts of its named spans."""
    return spans.filter(F.col("span_type").startswith("ner:")).groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_set("text")).alias("entities"))


NAME = r"[A-Z][\p{L}\p{N}'-]*(?:\s+[A-Z][\p{L}\p{N}'-]*)*+"
#: Rule forms of the phrases that a parser would find: names; numbers with the words they count; clauses from an auxiliary or a past form on.
PHRASES = {
    "noun_phrase": [rf"\b{NAME}", r"\b\d[\d.,]*(?:\s+\p{Ll}+){1,2}+"],
    "verb_clause": [r"\b(?:is|are|was|were|has|have|had|can|could|will|would|may|might|must|should|\p{Ll}{2,}ed)\b[^.;:,!?]*+"],
}


def phrase_spans(sentences: DataFrame) -> DataFrame:
    """doc_id, sentence_id, span_type, text, start_char, end_char of noun phrases, numeric phrases and verb clauses, by rules.

    The built-in forms of what a parser finds; a parser's rows with these columns can take their place. A numeric phrase has
    more than 2 characters and a digit, a verb clause more than 2 words.
    """
    base = sentences.select("doc_id", F.col("node_id").alias("sentence_id"), "text")
    found = None
    for kind, patterns in PHRASES.items():
        for pattern in patterns:
            each = base.select("doc_id", "sentence_id", F.lit(kind).alias("span_type"), F.col("text").alias("whole"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1), lambda x: F.trim(x)))).alias("text"))
            found = each if found is None else found.unionByName(each)
    kept = found.filter(F.when(F.col("span_type") == "verb_clause", X.word_count(F.col("text")) > 2).otherwise(F.length("text") > 2))
    placed = kept.withColumn("start_char", F.expr("locate(text, whole) - 1"))
    return placed.select("doc_id", "sentence_id", "span_type", "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char")).distinct()
