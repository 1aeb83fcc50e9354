"""Registered queries: the operators applied to the test tables, each over whole tables.

documents stand for pages, conversations for sentences of a document (conversation, turn, role), embeddings for
sentence vectors in documents of fifty, benchmark texts for questions and gold answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X
from graphloom.operators import answers, bm25, comparison, edges, evaluation, graphs, knowledge, models, passages, questions, reasoning, retrieval
from graphloom.sources import documents, sampling, sinks
from graphloom.sources.storage import cut

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")


def _turns(spark, sf):
    """Conversation turns as sentences: the words of ten letters or more are the entities."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_id"), F.col("turn").alias("sentence_id"), F.floor(F.col("turn") / 4).cast("int").alias("page"), F.col("role").alias("section"), "text")
    return t.withColumn("entities", F.filter(X.tokenize(F.col("text")), lambda w: F.length(w) >= 10))


def _sentences(spark, sf):
    """Sentences of documents: the words of ten letters or more are the entities."""
    s = passages.sentence_nodes(_pages(spark, sf)).withColumn("sentence_id", F.col("node_id"))
    return s.withColumn("entities", F.filter(X.tokenize(F.col("text")), lambda w: F.length(w) >= 10))


def _answer_pairs(spark, sf):
    """Each turn as the prediction for the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").withColumn("gold", F.lead("text").over(w)).filter("gold is not null").select("conv_id", "turn", F.col("text").alias("pred"), "gold")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("doc_id"), F.col("vec_id").alias("node_id"), "embedding")


def _graph(spark, sf):
    e = cut(edges.knn_edges(cut(edges.similarities(_vectors(spark, sf))), floor=0.05, quantile=0.80))
    return e.select(F.col("doc_id").alias("graph"), "src", "dst", "type", F.round("weight", 6).alias("weight"))


def _candidates(spark, sf):
    d = table(spark, sf, "documents")
    num = lambda c: c.cast("double")
    return d.select(
        F.col("source").alias("q_id"),
        F.col("doc_id").alias("span_id"),
        num(F.col("doc_id") * 37 % 101).alias("sem_raw"),
        num(F.col("n_chars") % 97).alias("lex"),
        num(F.col("doc_id") % 13).alias("cent"),
        (F.col("doc_id") % 5).cast("int").alias("overlap"),
        (F.col("doc_id") % 3 == 0).alias("sentence_overlap"),
        (F.col("doc_id") % 7).cast("int").alias("sentence_id"),
        F.col("doc_id").alias("rank_key"),
        F.col("text"),
    ).withColumn("sem", F.col("sem_raw") / 101)


@query
def sentence_split(spark, sf):
    s = X.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).alias("n_chars_kept"), F.md5(F.array_join(s, "\n")).alias("sentences_md5"))


@query
def sentence_nodes(spark, sf):
    return passages.sentence_nodes(_pages(spark, sf)).select("doc_id", "node_id", "sent_index", F.md5("text").alias("text_md5"))


@query
def section_detect(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\\n")).alias("line", "content"))
    return lines.select("doc_id", "line", X.section_title(F.col("content")).alias("title")).filter("title is not null")


@query
def clause_split(spark, sf):
    t = table(spark, sf, "conversations")
    c = X.clauses(F.col("text"))
    return t.select("conv_id", "turn", F.size(c).alias("n_clauses"), F.md5(F.array_join(c, "\n")).alias("clauses_md5"))


@query
def normalize_tokens(spark, sf):
    tokens = X.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


@query
def answer_normalize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.normalize_answer(F.col("text")).alias("answer"), F.size(X.answer_tokens(F.col("text"))).alias("n_tokens"))


@query
def html_pages(spark, sf):
    p = table(spark, sf, "pages")
    title, body = documents.html_text(F.col("html"))
    return p.select("page_id", title.alias("title"), body.alias("body"))


@query
def page_sections(spark, sf):
    p = documents.html_pages(table(spark, sf, "pages")).withColumn("title", F.when(F.col("page") % 3 == 0, F.col("title")))
    return documents.sections(p).select("doc_id", "section_id", "title", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query
def pattern_entities(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.explode(X.pattern_entities(F.col("text"))).alias("entity"))
    return found.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


@query
def person_entities(spark, sf):
    """Names by their capitals."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(X.pattern_entities(F.col("text"), False, {"PERSON/ORG": L.ENTITY_PATTERNS["PERSON/ORG"]})).alias("entity"))
    return found.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


@query
def discourse_types(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.discourse_types(F.col("text")), ",").alias("types"))


@query
def bm25_topk(spark, sf):
    return bm25.topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)


@query
def rag_bm25_topk(spark, sf):
    return bm25.topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5, bm25.whitespace_tokens)


@query
def evidence_recall(spark, sf):
    """Of each benchmark text, whether one of its five best documents contains it."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    top = bm25.topk(docs, items, "doc_id", "text", "item_id", "text", 5).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank")
    lists = top.join(docs.select("doc_id", "text"), "doc_id").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("evidence"))
    rows = items.join(lists, "item_id", "left")
    return rows.select("item_id", evaluation.evidence_recall_at(F.coalesce("evidence", F.array().cast("array<string>")), F.col("text"), 5).alias("recall_at_5"))


@query
def em_f1(spark, sf):
    p, g = F.col("pred"), F.col("gold")
    m = evaluation.precision_recall_f1(p, g)
    rounded = (F.round(m[c], 6).alias(c) for c in ("precision", "recall", "f1"))
    return _answer_pairs(spark, sf).select("conv_id", "turn", evaluation.exact_match(p, g).alias("em"), *rounded, evaluation.substring_match(p, g).alias("substring"))


@query
def f1_fallback(spark, sf):
    m = evaluation.f1_with_fallbacks(F.col("pred"), F.col("gold"))
    return _answer_pairs(spark, sf).select("conv_id", "turn", *(F.round(m[c], 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def metrics_by_level_type(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumns({"quality": F.col("quality").cast("double"), "toxic": F.col("toxic").cast("double")})
    return evaluation.metrics_by_group(rows, "lang", "source", ["quality", "toxic"])


@query
def level_type_counts(spark, sf):
    rows = table(spark, sf, "documents").withColumn("pred", F.when(F.col("n_chars") % 5 == 0, "ERROR").otherwise(F.col("text")))
    return evaluation.level_type_counts(rows, "source", "lang", ["en", "fr"], "pred")


@query
def answer_summary(spark, sf):
    rows = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 == 0, L.NO_ANSWER).otherwise(F.col("text")).alias("pred"), (F.col("doc_id") % 100 / 100).alias("confidence"))
    return evaluation.answer_summary(rows, "pred", "confidence")


@query
def stratified_sample(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("level"), F.when(F.col("n_chars") % 2 == 0, "bridge").otherwise("comparison").alias("type"))
    picked = sampling.stratified(rows, sampling.quotas(31, ("en", "fr", "de")), F.struct(F.col("doc_id") * 7919 % 1009, "doc_id"))
    return picked.select("doc_id", "level", "type", "pick")


@query
def structural_edges(spark, sf):
    return edges.resolve(edges.structural_edges(_turns(spark, sf))).select("doc_id", "src", "dst", "type", F.round("weight", 6).alias("weight"))


@query
def sequential_edges(spark, sf):
    spans = _turns(spark, sf).select("doc_id", "sentence_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "text"))
    spans = spans.withColumn("node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_id", "pos")))
    return edges.resolve(edges.span_structural_edges(spans)).select("doc_id", "src", "dst", "type", "weight")


@query
def discourse_edges(spark, sf):
    return edges.resolve(edges.discourse_edges(_turns(spark, sf), {"addition": ["that is"], "temporal": ["by th"], "contrast": [" pour "]})).select("doc_id", "src", "dst", "type", "weight")


@query
def cosine_threshold_edges(spark, sf):
    return edges.semantic_edges(edges.similarities(_vectors(spark, sf)), floor=0.05).select("doc_id", "src", "dst", F.round("weight", 6).alias("weight"))


@query
def knn_edges(spark, sf):
    return _graph(spark, sf).select("graph", "src", "dst", "weight")


@query
def entity_edges(spark, sf):
    return edges.resolve(edges.mention_pairs(edges.entity_mentions(_sentences(spark, sf)), "entity", 1)).select("doc_id", "src", "dst", "type", "weight")


@query
def mention_edges(spark, sf):
    _, e = edges.entity_node_edges(_sentences(spark, sf))
    return e.select("doc_id", "src", "dst", "type", "weight")


@query
def entity_relations(spark, sf):
    return edges.entity_relations(_sentences(spark, sf)).select("doc_id", "src", "dst", "type", "weight")


@query
def text_mentions(spark, sf):
    turns = _turns(spark, sf)
    names = turns.select("doc_id", F.explode("entities").alias("name")).distinct()
    return edges.text_mentions(turns, names)


@query
def degree(spark, sf):
    return graphs.degree(_graph(spark, sf))


@query
def degree_centrality(spark, sf):
    return graphs.degree_centrality(_graph(spark, sf)).select("graph", "node", F.round("centrality", 6).alias("centrality"))


@query
def density(spark, sf):
    return graphs.density(_graph(spark, sf))


@query
def pagerank_fixed(spark, sf):
    return graphs.pagerank(_graph(spark, sf), iterations=20).select("graph", "node", F.round("pagerank", 6).alias("pagerank"))


@query
def khop(spark, sf):
    g = _graph(spark, sf)
    return graphs.neighbourhood(g, graphs.nodes_of(g), 2)


@query
def shortest_path_len(spark, sf):
    g = _graph(spark, sf)
    pairs = graphs.nodes_of(g).select("graph", F.col("node").alias("a")).join(graphs.nodes_of(g).select("graph", F.col("node").alias("b")), "graph")
    return graphs.hop_distance(g, pairs)


@query
def components(spark, sf):
    return graphs.connected_components(_graph(spark, sf))


@query
def traversal(spark, sf):
    g = _graph(spark, sf).withColumn("type", F.when(F.col("weight") > 0.15, "condition").otherwise("semantic"))
    centrality = graphs.degree(g).select("graph", "node", F.col("degree").cast("double").alias("centrality"))
    return graphs.traverse(g, graphs.nodes_of(g).filter(F.col("node") % 20 == 0), centrality, L.TRAVERSABLE)


@query
def betweenness(spark, sf):
    return graphs.betweenness(_graph(spark, sf))


@query
def closeness(spark, sf):
    return graphs.closeness(_graph(spark, sf))


@query
def eigenvector(spark, sf):
    return graphs.eigenvector(_graph(spark, sf))


@query
def communities(spark, sf):
    return graphs.communities(_graph(spark, sf))


@query
def weighted_paths(spark, sf):
    g = _graph(spark, sf)
    pairs = graphs.nodes_of(g).select("graph", F.col("node").alias("a")).join(graphs.nodes_of(g).select("graph", F.col("node").alias("b")), "graph")
    return graphs.weighted_paths(g, pairs)


@query
def span_centrality(spark, sf):
    return graphs.span_centrality(_graph(spark, sf))


@query
def mmr(spark, sf):
    v = _vectors(spark, sf).select(F.col("doc_id").alias("q_id"), F.col("node_id").alias("span_id"), F.col("node_id").alias("rank"), (1 / (1 + F.col("node_id") % 50)).alias("score"), "embedding")
    return retrieval.mmr(v, 5)


@query
def diverse_evidence(spark, sf):
    v = _vectors(spark, sf).select(F.col("doc_id").alias("q_id"), F.col("node_id").alias("span_id"), F.col("node_id").alias("rank"), "embedding")
    return retrieval.diverse(v, 5)


@query
def diverse_by_section(spark, sf):
    rows = _turns(spark, sf).select(F.col("doc_id").alias("q_id"), F.col("node_id").alias("span_id"), "section", F.col("node_id").alias("rank"))
    return retrieval.diverse_by_section(rows, 3).select("q_id", "span_id", "pick")


@query
def minmax_fuse(spark, sf):
    return retrieval.weighted_combine(_candidates(spark, sf)).select("q_id", "span_id", F.round("score", 6).alias("score"))


@query
def hybrid_rank(spark, sf):
    return retrieval.hybrid(_candidates(spark, sf), 5).select("q_id", "span_id", "score", "rank")


@query
def rrf_merge(spark, sf):
    c = _candidates(spark, sf)
    a = evaluation.top_per(c, ["q_id"], "sem", "span_id", 20).select("q_id", "span_id", "rank")
    b = evaluation.top_per(c, ["q_id"], "lex", "span_id", 20).select("q_id", "span_id", "rank")
    return retrieval.fuse_variants(a.unionByName(b), 10).select("q_id", "span_id", F.round("rrf", 6).alias("rrf"), "rank")


@query
def candidate_union(spark, sf):
    c = _candidates(spark, sf)
    lists = {n: evaluation.top_per(c, ["q_id"], s, "span_id", 10) for n, s in (("hybrid", "sem"), ("traversal", "lex"), ("kg", "cent"))}
    return retrieval.votes(lists)


@query
def ordered_dedup(spark, sf):
    c = _candidates(spark, sf)
    return retrieval.ordered_union([evaluation.top_per(c, ["q_id"], s, "span_id", 10) for s in ("lex", "sem", "cent")]).select("q_id", "span_id", "pos")


@query
def final_score(spark, sf):
    c = _candidates(spark, sf)
    rows = c.select("q_id", "span_id", "sem", F.col("lex").alias("bm25"), (F.col("overlap") / 5).alias("overlap"), (F.col("cent") / 13).alias("sentence"), (F.col("cent") / 26).alias("cent"), *(F.when(F.col("span_id") % m == 0, 1.0).otherwise(0.0).alias(f"in_{n}") for n, m in (("hybrid", 2), ("traversal", 3), ("expansion", 5), ("kg", 7))), (F.col("span_id") % 4).alias("kg_hits"))
    scored = retrieval.final_scores(rows)
    return scored.select("q_id", "span_id", "score", retrieval.relevant(F.col("score"), F.round(F.col("overlap") * 5).cast("int"), F.col("sentence")).alias("relevant"))


@query
def expansions(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    top = bm25.topk(docs, items, "doc_id", "text", "item_id", "text", 3).select(F.col("query").alias("q_id"), F.col("doc").alias("doc_id"), "rank").join(docs.select("doc_id", "text"), "doc_id")
    return retrieval.expansions(top, items.select(F.col("item_id").alias("q_id"), F.col("text").alias("question")))


@query
def answer_rank(spark, sf):
    c = _candidates(spark, sf).select("q_id", "span_id", "sentence_id", "text", F.when(F.col("span_id") % 2 == 0, "sentence").otherwise("clause").alias("span_type"), "sem", "lex")
    rows = c.withColumns({"score": F.col("sem"), "pos": F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("lex"), "span_id")), "query": F.array(F.lit("the"), F.lit("andxx"), F.lit("menteau"))})
    return answers.rank_answers(rows).select("q_id", "span_id", "answer_score", "rank")


@query
def answer_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate_answer(F.col("text"), 220).alias("answer"))


@query
def confidence(spark, sf):
    c = X.blend_confidence(F.col("doc_id") % 150 / 100, F.col("n_chars") % 100 / 100)
    return table(spark, sf, "documents").select("doc_id", F.round(c, 6).alias("confidence"), X.confidence_label(F.round(c, 6)).alias("label"))


def _questions(spark, sf):
    """Questions of every form from the words of benchmark texts."""
    words = table(spark, sf, "benchmark").select("item_id", X.tokenize(F.col("text")).alias("w")).filter(F.size("w") >= 4)
    w = [F.get("w", F.lit(k)) for k in range(4)]
    forms = [
        ("Are {0} and {1} both {2}?", w),
        ("Which {0} was {1} and {2}?", w),
        ("Who is older, {0} or {1}?", w),
        ("Does {0} {1} that {2} does not?", w),
        ("When did the city of Paris have {0}?", w),
        ("Why is {0} {1} more than {2}?", w),
        ("What type of {0} do {1} and {2} have in common?", w),
        ("How is {0} different from {1}?", w),
        ("Tell {0} {1} {2} more and {3} {0} {1} now", w),
    ]
    rows = [F.struct(F.lit(k).alias("form"), F.format_string(f.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s").replace("{3}", "%4$s"), *v).alias("question")) for k, (f, v) in enumerate(forms)]
    return words.select("item_id", F.explode(F.array(*rows)).alias("q")).select("item_id", "q.form", "q.question")


@query
def question_type(spark, sf):
    return _questions(spark, sf).select("item_id", "form", questions.question_class(F.col("question")).alias("class"))


@query
def comparison_type(spark, sf):
    return _questions(spark, sf).select("item_id", "form", questions.comparison_type(F.col("question")).alias("type"))


@query
def decompose(spark, sf):
    q = F.col("question")
    return _questions(spark, sf).select("item_id", "form", F.array_join(questions.sub_questions(q, questions.question_class(q)), " | ").alias("parts"))


@query
def comparison_entities(spark, sf):
    return _questions(spark, sf).select("item_id", "form", questions.comparison_sides(F.col("question")).alias("s")).select("item_id", "form", "s.*")


@query
def comparison_refine(spark, sf):
    q = _questions(spark, sf).withColumns({"s": questions.comparison_sides(F.col("question")), "kind": questions.comparison_type(F.col("question"))})
    docs = table(spark, sf, "benchmark")
    rows = q.join(docs, "item_id").withColumns({"e1": F.array("text"), "e2": F.array(F.reverse("text")), "facts": F.array("text")})
    return rows.select("item_id", "form", comparison.refine(F.col("question"), F.col("kind"), F.col("text"), F.col("s.first"), F.col("s.second"), F.col("facts"), F.col("e1"), F.col("e2")).alias("answer"))


def _triples(spark, sf):
    rows = _sentences(spark, sf).withColumn("entities", F.transform("entities", lambda e: F.concat(F.when(F.length(e) % 2 == 0, "even:").otherwise("odd:"), e)))
    return knowledge.valid_triples(knowledge.related_triples(rows))


@query
def kg_triples(spark, sf):
    return knowledge.kg_edges(_triples(spark, sf))


@query
def kg_nodes(spark, sf):
    return knowledge.kg_nodes(_triples(spark, sf))


@query
def kg_stats(spark, sf):
    t = _triples(spark, sf)
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("labels")
    return knowledge.kg_stats(knowledge.kg_nodes(t), knowledge.kg_edges(t)).select("doc_id", "nodes", "edges", "density", labels)


@query
def kg_connectivity(spark, sf):
    """Of each document's knowledge graph, whether it is connected and its number of communities."""
    t = _triples(spark, sf)
    return knowledge.kg_stats(knowledge.kg_nodes(t), cut(knowledge.kg_edges(t)), components=True).select("doc_id", "connected", "communities")


@query
def kg_rule_triples(spark, sf):
    """Triples by rules, without the fallback."""
    t = knowledge.rule_triples(_sentences(spark, sf).withColumn("entities", F.array().cast("array<string>")))
    return t.select("doc_id", F.col("ord.node_id").alias("node_id"), "subject", "relation", "object")


@query
def phrase_spans(spark, sf):
    return passages.phrase_spans(_sentences(spark, sf)).select("doc_id", "sentence_id", "span_type", "start_char", "end_char", F.md5("text").alias("text_md5"))


@query
def kg_facts(spark, sf):
    e = cut(knowledge.kg_edges(_triples(spark, sf)))
    starts = e.select("doc_id", F.col("src").alias("start")).distinct()
    return knowledge.entity_facts(e, starts).select("doc_id", "start", F.array_join("facts", " | ").alias("facts"))


@query
def kg_paths(spark, sf):
    e = cut(knowledge.kg_edges(_triples(spark, sf)))
    pairs = e.select("doc_id", F.col("src").alias("a")).distinct().join(e.groupBy("doc_id").agg(F.max("dst").alias("b")), "doc_id")
    return knowledge.bridge_entities(knowledge.path_evidence(e, pairs)).select("doc_id", "a", "b", F.size("nodes").alias("n_nodes"), F.array_join("steps", " | ").alias("steps"))


@query
def kg_chains(spark, sf):
    e = cut(knowledge.kg_edges(_triples(spark, sf)))
    starts = e.select(F.col("doc_id").alias("q_id"), "doc_id", F.col("src").alias("name")).distinct()
    ends = e.select(F.col("doc_id").alias("q_id"), "doc_id", F.col("dst").alias("name")).distinct()
    return retrieval.kg_chains(starts, ends, e).select("q_id", "text", F.round("score", 6).alias("score"))


@query
def kg_communities(spark, sf):
    return knowledge.kg_metrics(knowledge.kg_edges(_triples(spark, sf)))


@query
def tfidf_importance(spark, sf):
    return bm25.importance(table(spark, sf, "documents"), "doc_id", "text", L.STOP_WORDS).select(F.col("doc").alias("doc_id"), F.round("importance", 6).alias("importance"))


@query
def spans(spark, sf):
    turns = _turns(spark, sf).withColumn("section", F.coalesce("section", F.lit("GLOBAL")))
    return passages.span_rows(turns).select("doc_id", "sentence_id", "ord", "span_type", "start_char", "end_char", F.md5("text").alias("text_md5"))


@query
def text_tables(spark, sf):
    return documents.text_tables(_pages(spark, sf)).select("doc_id", "table_id", F.size("rows").alias("n_rows"), F.size(F.get("rows", F.lit(0))).alias("n_cells"))


@query
def graph_export(spark, sf):
    turns, e = _turns(spark, sf), edges.resolve(edges.structural_edges(_turns(spark, sf)))
    return sinks.graph_json(turns, e).join(sinks.graphml(turns.select("doc_id", "node_id", "text", "entities"), e), "doc_id")


@query
def system_comparison(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    a = d.groupBy(F.col("lang").alias("system")).agg(evaluation.mean4(F.col("quality")).alias("exact_match"), evaluation.mean4(F.col("toxic")).alias("f1"))
    return sinks.comparison_table(a, ["exact_match", "f1"])


@query
def rag_prompts(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    top = bm25.topk(docs, items, "doc_id", "text", "item_id", "text", 5, bm25.whitespace_tokens).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank").join(docs.select("doc_id", "text"), "doc_id")
    context = top.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n").alias("context"))
    return items.join(context, "item_id").select("item_id", models.context_prompt(F.col("text"), F.col("context")).alias("prompt"))


def _span_edges(spark, sf):
    """Turns as spans, two to a sentence."""
    return reasoning.span_graph(_turns(spark, sf).withColumn("sentence_id", F.floor(F.col("node_id") / 2).cast("int")))


@query
def span_graph(spark, sf):
    return _span_edges(spark, sf).select("doc_id", "src", "dst", "type", "weight")


@query
def edge_type_counts(spark, sf):
    return reasoning.edge_types(_span_edges(spark, sf))


def _word_lengths(x):
    """A plain embedding without a model: how many words have each length up to 16."""
    sizes = F.transform(X.tokenize(x), lambda w: F.length(w))
    return F.transform(F.sequence(F.lit(1), F.lit(16)), lambda n: F.size(F.filter(sizes, lambda s: s == n)).cast("double"))


def _asked(spark, sf):
    """The first turn of each conversation asks its other turns."""
    first = _turns(spark, sf).filter("node_id = 0")
    return first.select(F.col("doc_id").alias("q_id"), "doc_id", F.col("text").alias("question"), _word_lengths(F.col("text")).alias("embedding"))


def _corpus(spark, sf):
    turns = cut(_turns(spark, sf).filter("node_id > 0").withColumns({"embedding": _word_lengths(F.col("text")), "span_id": F.struct("doc_id", "node_id")}))
    links = cut(reasoning.span_graph(turns))
    id_of = lambda c: F.struct("doc_id", F.col(c).alias("node_id")).alias(c)
    central = graphs.degree_centrality(links.select(F.col("doc_id").alias("graph"), "src", "dst")).select(F.col("graph").alias("doc_id"), F.col("node").alias("node_id"), "centrality")
    rows = turns.join(central, ["doc_id", "node_id"], "left")
    near = cut(edges.resolve(edges.structural_edges(turns)))
    kg = knowledge.kg_edges(knowledge.valid_triples(knowledge.related_triples(turns.withColumn("entities", F.transform("entities", lambda e: F.concat(F.lit("word:"), e))))))
    return reasoning.Corpus(
        cut(rows.select("doc_id", "span_id", F.col("node_id").alias("sentence_id"), "text", "section", "embedding", "centrality")),
        cut(rows.select("doc_id", F.col("node_id").alias("sentence_id"), "text", "embedding", F.col("centrality").alias("pagerank"))),
        links.select("doc_id", id_of("src"), id_of("dst"), "type"),
        near.select("doc_id", "src", "dst", "weight"),
        cut(kg.select("doc_id", "src", "dst")),
    )


@query
def reasoning_evidence(spark, sf):
    """Core run over every conversation: its first turn against the others."""
    evidence, _ = reasoning.run_core(_asked(spark, sf), _corpus(spark, sf), 3)
    return evidence.select("q_id", "span_id.node_id", "rank", F.round("score", 6).alias("score"), "relevant")


@query
def reasoning_parts(spark, sf):
    """The same with compound questions asked in parts."""
    evidence, _ = reasoning.reason(_asked(spark, sf), _corpus(spark, sf), 3)
    return evidence.select("q_id", "span_id.node_id", "rank", F.round("score", 6).alias("score"), "parts")


@query
def pages_to_answers(spark, sf):
    """From benchmark texts as pages to the answers to a question about each."""
    items = table(spark, sf, "benchmark")
    pages = items.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page"), "text")
    asked = items.select(F.col("item_id").alias("q_id"), F.col("item_id").alias("doc_id"), F.array_join(F.slice(X.tokenize(F.col("text")), 1, 4), " ").alias("question"))
    return reasoning.answer_questions(pages, asked, 5, _word_lengths).select("q_id", "answer", F.round("answer_score", 6).alias("answer_score"))


def _gold(spark, sf):
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("q_id")
    return _answer_pairs(spark, sf).select(key, "pred", F.col("gold").alias("answer"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("level"), F.when(F.col("conv_id") % 3 == 0, "bridge").otherwise("comparison").alias("type"))


@query
def batch_evaluation(spark, sf):
    g = _gold(spark, sf)
    _, means = reasoning.evaluate(g.filter("q_id % 7 > 0").select("q_id", F.col("pred").alias("answer")), g.drop("pred"))
    return means


@query
def system_metrics(spark, sf):
    g = _gold(spark, sf)
    echo = g.select(F.lit("echo").alias("system"), "q_id", F.col("pred").alias("answer"))
    some = g.filter("q_id % 2 = 0").select(F.lit("half").alias("system"), "q_id", "answer")
    return reasoning.compare_systems(echo.unionByName(some), g.drop("pred"))
