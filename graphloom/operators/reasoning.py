"""The reasoning run: from questions and the graphs of their documents to ranked evidence and chains, for many questions at once.

Everything is keyed by question: a question meets only the spans of its own document, and the span graph's edges are
taken once for each question that asks the document, so seeds of different questions never mix. Model scores are plug
points: embeddings come with the tables, and a query's expansions and parts keep the question's embedding unless an
`embed` function of the query column is given; without a re-ranker the fused score decides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X
from graphloom.operators import answers, bm25, edges, evaluation, graphs, models, passages, questions, retrieval
from graphloom.sources.storage import cut


@dataclass
class Corpus:
    """The graphs of the documents that are asked.

    spans: doc_id, span_id, sentence_id, text, section, embedding, centrality; sentences: doc_id, sentence_id, text,
    embedding, pagerank; span_edges: doc_id, src, dst, type; sentence_edges: doc_id, src, dst, weight; kg_edges:
    doc_id, src, dst. Span ids are unique over the documents.
    """

    spans: DataFrame
    sentences: DataFrame
    span_edges: DataFrame
    sentence_edges: DataFrame
    kg_edges: DataFrame


def span_graph(spans: DataFrame, sims: DataFrame | None = None, aligned: DataFrame | None = None, floor: float = 0.75, quantile: float = 0.85) -> DataFrame:
    """The span graph's edges: structure, similarity, discourse, shared entities and shared knowledge-graph entities, resolved in this order.

    spans: doc_id, node_id, sentence_id, text, entities; sims: doc_id, src, dst, sim; aligned: doc_id, node_id,
    kg_entities (of align_sentences). Of several edges between two spans the type and weight of the last family stay.
    """
    every = edges.span_structural_edges(spans).unionByName(edges.discourse_edges(spans))
    every = every.unionByName(edges.mention_pairs(edges.entity_mentions(spans), "entity_overlap", 7))
    if sims is not None:
        every = every.unionByName(edges.semantic_edges(sims, floor, quantile))
    if aligned is not None:
        every = every.unionByName(edges.mention_pairs(edges.entity_mentions(aligned, "kg_entities"), "kg_overlap", 8))
    return edges.resolve(every)


def edge_types(resolved: DataFrame) -> DataFrame:
    """type and n: how many edges of each type there are."""
    return resolved.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _terms(x: Column) -> Column:
    return F.array_distinct(X.tokenize(x))


def _ratio(shared: Column, terms: Column) -> Column:
    return F.least(F.lit(1.0), shared / F.greatest(F.lit(1), F.size(terms)))


def span_features(asked: DataFrame, corpus: Corpus) -> DataFrame:
    """Each query (q_id, doc_id, question, embedding) against each span of its document: q_id, span_id, sem, lex, cent, overlap, sentence_overlap, q_terms, content, text, sentence_id, section, embedding."""
    q = asked.select("q_id", "doc_id", _terms(F.col("question")).alias("terms"), F.col("embedding").alias("q_embedding"))
    own = corpus.sentences.select("doc_id", "sentence_id", _terms(F.col("text")).alias("sentence_terms"))
    spans = corpus.spans.withColumn("span_terms", _terms(F.col("text"))).join(own, ["doc_id", "sentence_id"], "left")
    lex = bm25.score(corpus.spans, asked, "span_id", "text", "q_id", "question", per=["doc_id"]).select(F.col("query").alias("q_id"), F.col("doc").alias("span_id"), F.col("score").alias("lex"))
    rows = q.join(spans, "doc_id").join(lex, ["q_id", "span_id"], "left")
    shared = F.size(F.array_intersect("terms", "span_terms"))
    return rows.select(
        "q_id",
        "doc_id",
        "span_id",
        X.cosine(F.col("q_embedding"), F.col("embedding")).alias("sem"),
        F.coalesce("lex", F.lit(0.0)).alias("lex"),
        F.coalesce("centrality", F.lit(0.0)).alias("cent"),
        shared.alias("overlap"),
        F.coalesce(F.arrays_overlap("terms", "sentence_terms"), F.lit(False)).alias("sentence_overlap"),
        _ratio(shared, F.col("terms")).alias("ratio"),
        retrieval.content_overlap(F.col("terms"), F.col("span_terms")).alias("content"),
        "text",
        "sentence_id",
        "section",
        "embedding",
    )


def sentence_relevance(asked: DataFrame, corpus: Corpus) -> DataFrame:
    """q_id, sentence_id and the score of each sentence of the query's document."""
    q = asked.select("q_id", "doc_id", _terms(F.col("question")).alias("terms"), F.col("embedding").alias("q_embedding"))
    named = corpus.sentences.withColumn("key", F.struct("doc_id", "sentence_id"))
    lex = bm25.score(named, asked, "key", "text", "q_id", "question", per=["doc_id"]).select(F.col("query").alias("q_id"), F.col("doc.sentence_id").alias("sentence_id"), F.col("score").alias("bm25"))
    rows = q.join(corpus.sentences, "doc_id").join(lex, ["q_id", "sentence_id"], "left")
    shared = F.size(F.array_intersect("terms", _terms(F.col("text"))))
    ready = rows.select("q_id", "sentence_id", X.cosine(F.col("q_embedding"), F.col("embedding")).alias("sem"), shared.alias("overlap"), F.size("terms").alias("q_terms"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
    return retrieval.sentence_scores(ready).select("q_id", "sentence_id", F.col("score").alias("sentence"))


def _mentions(corpus: Corpus, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, span_id, name of the knowledge-graph names in spans; q_id, doc_id, name of those in queries."""
    names = corpus.kg_edges.select("doc_id", F.col("src").alias("name")).union(corpus.kg_edges.select("doc_id", F.col("dst").alias("name"))).distinct()
    spans = edges.text_mentions(corpus.spans.select("doc_id", F.col("span_id").alias("node_id"), "text"), names).select("doc_id", F.col("node_id").alias("span_id"), "name")
    texts = asked.select("doc_id", F.col("q_id").alias("node_id"), X.normalize_text(F.col("question")).alias("text"))
    return spans, edges.text_mentions(texts, names).select(F.col("node_id").alias("q_id"), "doc_id", "name")


def run_core(asked: DataFrame, corpus: Corpus, k: int = 10, embed: Callable[[Column], Column] | None = None, reranker: models.Loader | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence and chains of each query. asked: q_id, doc_id, question, embedding.

    Four strategies propose candidates: hybrid ranking, traversal of the span graph from the hybrid seeds, hybrid ranking
    of the expanded queries fused by rank, and spans that mention the query's knowledge-graph entities or their
    neighbours. All are scored with the weights of lexicons.CORE_WEIGHTS; the best 2k are re-ranked, reordered by maximal marginal
    relevance, and filtered for relevance; where fewer than k stay, the others fill up in their order. Returns
    evidence (q_id, span_id, score, relevant, rank from 1, the in_ flags) and chains (q_id, type, nodes, text, score, rank).
    Chains keep sentence ids apart from span ids. Questions of documents without spans have no rows.
    """
    asked = cut(asked.select("q_id", "doc_id", "question", "embedding"))
    features = cut(span_features(asked, corpus))
    sentences = cut(sentence_relevance(asked, corpus))
    hybrid = retrieval.hybrid(features, 2 * k).select("q_id", "span_id", "rank")

    seeds = retrieval.hybrid(features, 5).select(F.col("q_id").alias("graph"), F.col("span_id").alias("node"))
    own_edges = asked.select(F.col("q_id").alias("graph"), "doc_id").join(corpus.span_edges, "doc_id").select("graph", "src", "dst", "type")
    central = features.select(F.col("q_id").alias("graph"), F.col("span_id").alias("node"), F.col("cent").alias("centrality"))
    reached = graphs.traverse(own_edges, seeds, central, L.TRAVERSABLE).select("graph", "node").union(seeds).distinct()
    traversal = retrieval.traversal_scores(features.join(reached.select(F.col("graph").alias("q_id"), F.col("node").alias("span_id")), ["q_id", "span_id"]), 2 * k).select("q_id", "span_id", "rank")

    best = evaluation.top_per(features, ["q_id"], "sem", "span_id", 3).select("q_id", "rank", "text")
    variants = retrieval.expansions(best, asked.select("q_id", "question")).withColumn("name", F.struct("q_id", "variant"))
    vector = embed(F.col("query")) if embed else F.col("embedding")
    grown = variants.join(asked.select("q_id", "doc_id", "embedding"), "q_id").select(F.col("name").alias("q_id"), "doc_id", F.col("query").alias("question"), vector.alias("embedding"))
    lists = retrieval.hybrid(span_features(cut(grown), corpus), 2 * k).select("q_id.q_id", "span_id", "rank")
    expansion = retrieval.fuse_variants(lists, 2 * k).select("q_id", "span_id", "rank")

    mentions, entities = (cut(t) for t in _mentions(corpus, asked))
    kg = retrieval.kg_guided(mentions, corpus.kg_edges, entities, features.select("q_id", "span_id", "sem"), 2 * k).select("q_id", "span_id", "rank")

    found = retrieval.votes({"hybrid": hybrid, "traversal": traversal, "expansion": expansion, "kg": kg})
    hits = mentions.groupBy("span_id").agg(F.count_distinct("name").alias("kg_hits"))
    rows = found.join(features, ["q_id", "span_id"]).join(sentences, ["q_id", "sentence_id"], "left").join(hits, "span_id", "left").na.fill(0, ["sentence", "kg_hits"])
    scored = cut(retrieval.final_scores(rows.withColumns({"bm25": F.col("lex"), "overlap": F.col("ratio")})))
    top = evaluation.top_per(scored, ["q_id"], "score", "span_id", 2 * k)
    if reranker is not None:
        top = models.rerank(top.join(asked.select("q_id", "question"), "q_id"), reranker)
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("rerank"), "span_id")))
    picks = retrieval.mmr(top.select("q_id", "span_id", "score", "embedding", "rank"), 2 * k)
    flags = [f"in_{n}" for n in ("hybrid", "traversal", "expansion", "kg")]
    ready = cut(picks.join(top.select("q_id", "doc_id", "span_id", "sentence_id", "score", retrieval.relevant(F.col("score"), F.col("content"), F.col("sentence")).alias("relevant"), *flags), ["q_id", "span_id"]))
    order = Window.partitionBy("q_id").orderBy(F.desc("relevant"), "pick")
    evidence = ready.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q_id", "span_id", "score", "relevant", "rank", *flags)
    return evidence, evidence_chains(ready, corpus, entities)


def evidence_chains(ready: DataFrame, corpus: Corpus, entities: DataFrame, most: int = 3) -> DataFrame:
    """The best chains between the sentences of the first five spans: shortest weighted paths, and knowledge-graph bridges from the query's entities.

    ready: q_id, doc_id, sentence_id, pick. Returns q_id, type, nodes (text), text, score, rank.
    """
    first = ready.filter("pick <= 5").groupBy("q_id", "doc_id", "sentence_id").agg(F.min("pick").alias("pick"))
    seeds = cut(first.withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy("pick"))).filter("n <= 4"))
    a, b = (seeds.select("q_id", "doc_id", F.col("n").alias(f"n{s}"), F.col("sentence_id").alias(s)) for s in "ab")
    pairs = a.join(b, ["q_id", "doc_id"]).filter("na < nb and na <= 3").select(F.col("q_id").alias("graph"), "doc_id", "a", "b")
    own = seeds.select("q_id", "doc_id").distinct().join(corpus.sentence_edges, "doc_id").select(F.col("q_id").alias("graph"), "src", "dst", "weight")
    paths = graphs.weighted_paths(own, pairs).select(F.col("graph").alias("q_id"), "nodes").join(seeds.select("q_id", "doc_id").distinct(), "q_id")
    by_path = retrieval.path_chains(paths, corpus.sentences.select("doc_id", F.col("sentence_id").alias("node_id"), "text", "pagerank"))
    names = entities.select("doc_id", "name").union(corpus.kg_edges.select("doc_id", F.col("src").alias("name"))).union(corpus.kg_edges.select("doc_id", F.col("dst").alias("name"))).distinct()
    near = seeds.filter("n <= 3").join(corpus.sentences.select("doc_id", "sentence_id", "text"), ["doc_id", "sentence_id"])
    in_sentence = edges.text_mentions(near.select("doc_id", F.col("sentence_id").alias("node_id"), "text").distinct(), names).withColumnRenamed("node_id", "sentence_id")
    ends = near.select("q_id", "doc_id", "sentence_id").join(in_sentence, ["doc_id", "sentence_id"]).select("q_id", "doc_id", "name").distinct()
    bridges = retrieval.kg_chains(entities, ends, corpus.kg_edges)
    text = lambda df: df.select("q_id", "type", F.transform("nodes", lambda n: n.cast("string")).alias("nodes"), "text", F.round("score", 6).alias("score"))
    return retrieval.merge_chains(text(by_path).unionByName(text(bridges)), most)


def reason(asked: DataFrame, corpus: Corpus, k: int = 10, embed: Callable[[Column], Column] | None = None, reranker: models.Loader | None = None) -> tuple[DataFrame, DataFrame]:
    """run_core over each question, or over each part of a compound one with the parts' scores summed: evidence (q_id, span_id, score, rank, parts), chains.

    asked: q_id, doc_id, question, embedding. Evidence of a simple question keeps the core's order; that of a compound one
    is by summed score, the k best, ties by span. Chains with one text count once, the best three stay.
    """
    q = F.col("question")
    parts = asked.withColumn("parts", questions.sub_questions(q, questions.question_class(q)))
    each = parts.select("q_id", F.size("parts").alias("n_parts"), "doc_id", "embedding", F.posexplode("parts").alias("part", "question"))
    vector = F.when(F.col("n_parts") > 1, embed(q)).otherwise(F.col("embedding")) if embed else F.col("embedding")
    named = each.select(F.struct("q_id", "part", "n_parts").alias("q_id"), "doc_id", "question", vector.alias("embedding"))
    evidence, chains = run_core(named, corpus, k, embed, reranker)
    found = evidence.select("q_id.q_id", "q_id.n_parts", "span_id", "score", "rank")
    merged = found.groupBy("q_id", "span_id").agg(F.max("n_parts").alias("parts"), F.round(F.sum("score"), 6).alias("score"), F.min("rank").alias("core"))
    order = Window.partitionBy("q_id").orderBy(F.when(F.col("parts") == 1, F.col("core")), F.desc("score"), "span_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    joined = chains.select("q_id.q_id", "type", "nodes", "text", "score")
    return ranked.select("q_id", "span_id", "score", "rank", "parts"), retrieval.merge_chains(joined, 3)


def answer_questions(pages: DataFrame, asked: DataFrame, k: int = 10, embed: Callable[[Column], Column] | None = None, reader: models.Loader | None = None) -> DataFrame:
    """From pages to answers: q_id, answer, span_id, answer_score.

    pages: doc_id, page, text; asked: q_id, doc_id, question. Pages become sentences and spans, these the graphs, the
    graphs evidence, and the evidence an answer: the reader's where there is one and it is sure enough, else the
    best-ranked span, in its sentence where that is short. Questions without evidence get lexicons.NO_ANSWER.
    """
    vector = embed or (lambda x: models.embed(x))
    nodes = cut(passages.with_entities(passages.sentence_nodes(pages)))
    spans = cut(passages.span_rows(nodes).withColumn("node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_id", "ord")) - 1))
    spans = cut(passages.with_entities(spans).withColumns({"span_id": F.struct("doc_id", "node_id"), "embedding": vector(F.col("text"))}))
    links = cut(span_graph(spans, edges.similarities(spans)))
    as_graph = links.select(F.col("doc_id").alias("graph"), "src", "dst", "weight")
    central = graphs.span_centrality(as_graph).select(F.col("graph").alias("doc_id"), F.col("node").alias("node_id"), "centrality")
    id_of = lambda c: F.struct("doc_id", F.col(c).alias("node_id"))
    near = cut(edges.resolve(edges.structural_edges(nodes)))
    rank = graphs.pagerank(near.select(F.col("doc_id").alias("graph"), "src", "dst", "weight"), tolerance=1e-6).select(F.col("graph").alias("doc_id"), F.col("node").alias("sentence_id"), "pagerank")
    sentences = nodes.select("doc_id", F.col("node_id").alias("sentence_id"), "text", vector(F.col("text")).alias("embedding")).join(rank, ["doc_id", "sentence_id"], "left")
    corpus = Corpus(
        cut(spans.join(central, ["doc_id", "node_id"], "left").select("doc_id", "span_id", "sentence_id", "text", "section", "embedding", "centrality")),
        cut(sentences),
        links.select("doc_id", id_of("src").alias("src"), id_of("dst").alias("dst"), "type"),
        near.select("doc_id", "src", "dst", "weight"),
        nodes.select("doc_id", F.lit("").alias("src"), F.lit("").alias("dst")).limit(0),
    )
    evidence, _ = reason(asked.select("q_id", "doc_id", "question", vector(F.col("question")).alias("embedding")), corpus, k, embed)
    rows = cut(evidence.join(spans.select("doc_id", "span_id", "sentence_id", "text", "span_type"), "span_id").join(asked.select("q_id", "question"), "q_id"))
    ranked = answers.rank_answers(rows.select("q_id", "doc_id", "span_id", "sentence_id", "text", "span_type", "score", F.col("rank").alias("pos"), X.tokenize(F.col("question")).alias("query")))
    best = answers.promote(ranked.filter("rank = 1"), nodes)
    contexts = rows.groupBy("q_id", "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), " ").alias("context"))
    read = models.read_answers(contexts, reader).filter((F.col("qa_score") >= 0.05) & (F.length(F.trim("answer")) > 0)).select("q_id", F.col("answer").alias("read"))
    out = asked.select("q_id").join(best.select("q_id", "span_id", "answer_score", "text"), "q_id", "left").join(read, "q_id", "left")
    return out.select("q_id", F.coalesce("read", X.truncate_answer(F.col("text"), 220), F.lit(L.NO_ANSWER)).alias("answer"), "span_id", "answer_score")


def evaluate(predictions: DataFrame, gold: DataFrame, metrics: tuple[str, ...] = ("exact_match", "f1")) -> tuple[DataFrame, DataFrame]:
    """Batch evaluation: one row per question (q_id, level, type, exact_match, precision, recall, f1), and the means by level, type, both and all.

    predictions: q_id, answer; gold: q_id, answer, level, type. A question without a prediction counts as unanswered.
    """
    pred = predictions.select("q_id", F.col("answer").alias("pred"))
    rows = gold.select("q_id", F.col("answer").alias("gold"), "level", "type").join(pred, "q_id", "left").withColumn("pred", F.coalesce("pred", F.lit("")))
    m = evaluation.precision_recall_f1(F.col("pred"), F.col("gold"))
    each = rows.select("q_id", "level", "type", evaluation.exact_match(F.col("pred"), F.col("gold")).alias("exact_match"), *(m[c].alias(c) for c in ("precision", "recall", "f1")))
    return each, evaluation.metrics_by_group(each, "level", "type", list(metrics))


def compare_systems(predictions: DataFrame, gold: DataFrame, metrics: tuple[str, ...] = ("exact_match", "f1")) -> DataFrame:
    """system, questions and the mean of each metric, for answers of several systems (system, q_id, answer) to the same questions.

    Every system is held to every gold question: one that it didn't answer counts as unanswered. Systems come from the data.
    """
    every = predictions.select("system").distinct()
    asked = predictions.select("system", "q_id", F.col("answer").alias("pred")).join(gold.select("q_id", F.col("answer").alias("gold")), "q_id")
    m = evaluation.precision_recall_f1(F.col("pred"), F.col("gold"))
    scored = asked.select("system", evaluation.exact_match(F.col("pred"), F.col("gold")).alias("exact_match"), m["precision"].alias("precision"), m["recall"].alias("recall"), m["f1"].alias("f1"))
    total = gold.count()
    sums = scored.groupBy("system").agg(F.count(F.lit(1)).alias("answered"), *(F.sum(c).alias(c) for c in metrics))
    means = (F.round(F.coalesce(c, F.lit(0.0)) / F.lit(max(1, total)), 4).alias(c) for c in metrics)
    return every.join(sums, "system", "left").select("system", F.lit(total).alias("questions"), F.coalesce("answered", F.lit(0)).alias("answered"), *means)
