"""Selection, evidence and chain operators on small fixtures."""

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import answers, edges, evaluation, graphs, knowledge, passages, retrieval
from graphloom.streaming.incremental import append_records


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_contexts_are_reordered_only_for_a_clear_winner(spark):
    c = spark.createDataFrame([(1, 0, "x y"), (1, 1, "cat dog cat"), (2, 0, "cat"), (2, 1, "cat z w")], "q_id int, pos int, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "cat")], "q_id int, question string")
    assert rows(answers.reorder_contexts(c, q), "q_id", "place", "pos") == [(1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 1)]


def test_reader_contexts_of_three_passes(spark):
    c = spark.createDataFrame([(1, 1, "aaa", ["s1", "s2"]), (1, 2, "bbb", [])], "q_id int, place int, text string, sentences array<string>")
    assert rows(answers.qa_contexts(c), "pass", "ord", "context") == [(1, 1, "aaa"), (1, 2, "bbb"), (2, 1, "aaa bbb"), (3, 0, "s1"), (3, 1, "s2")]


def test_ranking_keeps_two_spans_a_sentence_and_evidence_three(spark):
    data = [("q", i, 1 if i < 4 else 2, f"cat number {i}", "clause", 0.5 - i / 100, i + 1, ["cat"]) for i in range(6)]
    df = spark.createDataFrame(data, "q_id string, span_id int, sentence_id int, text string, span_type string, score double, pos int, query array<string>")
    ranked = answers.rank_answers(df)
    assert rows(ranked, "rank", "span_id") == [(1, 0), (2, 1), (3, 4), (4, 5)]
    assert answers.keep_evidence(ranked).count() == 3


def test_promotion_and_fallback(spark):
    s = spark.createDataFrame([("d", 0, "the whole sentence here"), ("d", 1, "a dog barks")], "doc_id string, node_id int, text string")
    a = spark.createDataFrame([("q", "d", 0, "whole", "clause"), ("r", "d", 1, "a dog barks", "sentence")], "q_id string, doc_id string, sentence_id int, text string, span_type string")
    assert rows(answers.promote(a, s), "q_id", "text") == [("q", "the whole sentence here"), ("r", "a dog barks")]
    missed = spark.createDataFrame([("q", 0, ["dog"], "d"), ("r", 1, ["dog"], "d")], "q_id string, overlap int, query array<string>, doc_id string")
    assert rows(answers.fallback_sentences(missed, s), "q_id", "node_id") == [("q", 1)]


def test_entity_evidence_fills_up_with_pages_and_facts(spark):
    e = spark.createDataFrame([("q", "Ann"), ("q", "Bob")], "q_id string, entity string")
    spans = spark.createDataFrame([("q", 1, "ann sang"), ("q", 2, "none")], "q_id string, ord int, text string")
    pages = spark.createDataFrame([("q", 1, "page of Ann")], "q_id string, ord int, text string")
    facts = spark.createDataFrame([("q", "Ann", ["ann is x"])], "q_id string, entity string, facts array<string>")
    assert rows(answers.entity_evidence(spans, pages, facts, e), "entity", "texts") == [("Ann", ["ann sang", "page of Ann", "ann is x"]), ("Bob", [])]


def test_bridge_evidence_and_chains(spark):
    e = spark.createDataFrame([("d", "ann lee", "acme", "works_at", 1.0), ("d", "acme", "paris", "is_in", 1.0)], "doc_id string, src string, dst string, relation string, weight double")
    n = spark.createDataFrame([("d", "ann lee", 0.5), ("d", "acme", 0.3), ("d", "paris", 0.2)], "doc_id string, text string, pagerank double")
    q = spark.createDataFrame([("d", "q", "Is Ann in Paris?")], "doc_id string, q_id string, question string")
    assert knowledge.bridge_evidence(n, e, q).first()["evidence"] == ["ann lee -[works_at]-> acme", "acme -[is_in]-> paris"]
    start = knowledge.match_entity(n, spark.createDataFrame([("d", "Ann")], "doc_id string, name string")).first()["start"]
    assert start == "ann lee"
    ends = spark.createDataFrame([("q", "d", "paris")], "q_id string, doc_id string, name string")
    begins = spark.createDataFrame([("q", "d", "ann lee")], "q_id string, doc_id string, name string")
    assert rows(retrieval.kg_chains(begins, ends, e), "nodes") == [(["ann lee", "acme", "paris"],)]
    paths = spark.createDataFrame([("q", "d", [0, 1]), ("q", "d", [0])], "q_id string, doc_id string, nodes array<int>")
    s = spark.createDataFrame([("d", 0, "one", 0.2), ("d", 1, "two", 0.4)], "doc_id string, node_id int, text string, pagerank double")
    got = retrieval.path_chains(paths, s).collect()
    assert [(r["text"], round(r["score"], 6)) for r in got] == [("one -> two", 0.3)]
    chains = spark.createDataFrame([("q", "a", 0.1), ("q", "a", 0.3), ("q", "b", 0.2)], "q_id string, text string, score double")
    assert rows(retrieval.merge_chains(chains), "rank", "text") == [(1, "a"), (2, "b")]


def test_guided_retrieval_expansion_and_alignment(spark):
    mentions = spark.createDataFrame([("d", 1, "acme"), ("d", 2, "zed")], "doc_id string, span_id int, name string")
    e = spark.createDataFrame([("d", "ann", "acme")], "doc_id string, src string, dst string")
    qe = spark.createDataFrame([("q", "d", "ann")], "q_id string, doc_id string, name string")
    sims = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.9)], "q_id string, span_id int, sem double")
    assert rows(retrieval.kg_guided(mentions, e, qe, sims), "span_id") == [(1,)]
    top = spark.createDataFrame([("q", 1, "the new words follow here again"), ("q", 2, "new")], "q_id string, rank int, text string")
    asked = spark.createDataFrame([("q", "what is new")], "q_id string, question string")
    assert rows(retrieval.expansions(top, asked), "variant", "query") == [(0, "what is new"), (1, "what is new the words follow here")]
    sentences = spark.createDataFrame([("d", 0, "Ann met C. Acme, not acmeland")], "doc_id string, node_id int, text string")
    names = spark.createDataFrame([("d", "ann"), ("d", "acme"), ("d", "acm"), ("d", "land")], "doc_id string, text string")
    assert knowledge.align_sentences(sentences, names).first()["kg_entities"] == ["acme", "ann"]


def test_scores_weights_and_groups(spark):
    df = spark.createDataFrame([("q", 1, 0.4, 2, 4, 1.0, 0.1), ("q", 2, 0.2, 0, 4, 3.0, 0.2)], "q_id string, span_id int, sem double, overlap int, q_terms int, bm25 double, pagerank double")
    assert [round(r[1], 6) for r in rows(retrieval.sentence_scores(df), "span_id", "score")] == [0.315, 0.31]
    t = spark.createDataFrame([("q", 1, 0.4, 0.1, 2, "but not this")], "q_id string, span_id int, sem double, cent double, overlap int, text string")
    assert retrieval.traversal_scores(t).first()["score"] == 0.6
    best = evaluation.best_of(spark.createDataFrame([(1, 0.5, 0.1), (1, 0.2, 0.7)], "id int, f1 double, em double"), ["id"], ["f1", "em"])
    assert rows(best, "f1", "em") == [(0.5, 0.7)]
    w = spark.createDataFrame([("if x", "when y, but not z")], "a string, b string").select(X.discourse_weight(F.col("a"), F.col("b")).alias("w")).first()["w"]
    assert round(w, 6) == 0.85
    g = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], "graph int, src int, dst int, weight double")
    assert {round(r["centrality"], 6) for r in graphs.span_centrality(g, 4).collect()} == {0.25}
    n = spark.createDataFrame([("d", 0, 0, ["x"]), ("d", 1, 0, ["x", "y"])], "doc_id string, node_id int, sentence_id int, entities array<string>")
    nodes, links = edges.entity_node_edges(n)
    assert nodes.count() == 2 and links.count() == 6
    named = spark.createDataFrame([("d", 0, "ner:X", "b"), ("d", 0, "ner:X", "a"), ("d", 0, "clause", "c")], "doc_id string, sentence_id int, span_type string, text string")
    assert passages.sentence_entity_sets(named).first()["entities"] == ["a", "b"]


def test_records_append_exactly_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1)], "q_id string, n int").write.json(str(source))
    stream = spark.readStream.schema("q_id string, n int").json(str(source))
    for _ in range(2):
        append_records(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
