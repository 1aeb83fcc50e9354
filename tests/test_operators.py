"""Operators on hand-computed fixtures and by their properties."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answers, bm25, comparison, edges, evaluation, graphs, knowledge, models, passages, questions, retrieval
from graphloom.sources import documents, sampling, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


GOLDENS = [
    ("Yes, they are.", "yes", 0, 0.3333, 1.0, 0.5),
    ("The Tuxedo.", "Tuxedo", 1, 1.0, 1.0, 1.0),
    ("music videos.", "music", 0, 0.5, 1.0, 0.6667),
    ("James Hanley", "James (Joseph) Hanley", 0, 1.0, 0.6667, 0.8),
    ("Pakistan.", "Pakistan", 1, 1.0, 1.0, 1.0),
    ("fast escorts", '"Iowa"-class battleships', 0, 0.0, 0.0, 0.0),
    ("Bougainville – Our Island Our Fight.", "Bougainville – Our Island Our Fight", 1, 1.0, 1.0, 1.0),
]


def test_answer_metrics_match_recorded_values(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GOLDENS)], "i int, p string, g string, em int, pr double, re double, f double")
    m = evaluation.precision_recall_f1(F.col("p"), F.col("g"))
    for r in df.select("*", evaluation.exact_match(F.col("p"), F.col("g")).alias("got"), m.alias("m")).collect():
        assert r["got"] == r["em"]
        assert [round(r["m"][k], 4) for k in ("precision", "recall", "f1")] == [r["pr"], r["re"], r["f"]]


def test_fallback_scores_and_empty_predictions(spark):
    df = spark.createDataFrame([("York", "Yorkshire", 0.6), ("100 kg", "100.5", 1.0), ("", "", 1.0), ("x", "", 0.0), ("cat", "dog", 0.0)], "p string, g string, f double")
    for r in df.select("f", evaluation.f1_with_fallbacks(F.col("p"), F.col("g"))["f1"].alias("got")).collect():
        assert math.isclose(r["f"], r["got"], abs_tol=1e-9)
    assert df.select(evaluation.substring_match(F.lit(""), F.col("g")).alias("s")).agg(F.min("s")).first()[0] == 1.0


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c")], "d int, t string")
    q = spark.createDataFrame([(1, "c"), (2, "c a a")], "q int, t string")
    got = {(r["query"], r["doc"]): r["score"] for r in bm25.score(docs, q, "d", "t", "q", "t").collect()}
    assert round(got[1, 2], 6) == 0.930399 and (1, 1) not in got
    assert round(got[2, 1], 6) == 0.400707 and round(got[2, 2], 6) == 1.264934


def test_pagerank_fixture_and_sum(spark):
    e = spark.createDataFrame([(1, "a", "b", 1.0), (1, "a", "c", 3.0), (1, "b", "c", 1.0)], "graph int, src string, dst string, weight double")
    got = {r["node"]: r["pagerank"] for r in graphs.pagerank(e, iterations=20).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0.204892, "b": 0.248431, "c": 0.546677}
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9)


@pytest.fixture(scope="module")
def path_graph(spark):
    return spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 1.0), (2, 7, 8, 0.5), (2, 8, 7, 0.5), (2, 7, 7, 1.0)], "graph int, src int, dst int, weight double")


def test_graph_measures(spark, path_graph):
    g = path_graph
    assert rows(graphs.degree(g), "graph", "node", "degree") == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 1), (2, 7, 4), (2, 8, 2)]
    assert rows(graphs.connected_components(g), "graph", "node", "component") == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 7, 7), (2, 8, 7)]
    assert [(r[0], round(r[1], 4)) for r in rows(graphs.betweenness(g).filter("graph = 1"), "node", "betweenness")] == [(1, 0.0), (2, 0.3333), (3, 0.3333), (4, 0.0)]
    assert [round(r[1], 4) for r in rows(graphs.closeness(g).filter("graph = 1"), "node", "closeness")] == [0.0, 0.3333, 0.4444, 0.5]
    assert rows(graphs.density(g), "graph", "density") == [(1, 0.25), (2, 1.5)]
    x = {r["node"]: r["eigenvector"] for r in graphs.eigenvector(g.filter("graph = 2"), 4).collect()}
    assert math.isclose(sum(v * v for v in x.values()), 1.0)


def test_paths_and_neighbourhoods(spark, path_graph):
    starts = spark.createDataFrame([(1, 1)], "graph int, node int")
    assert rows(graphs.neighbourhood(path_graph, starts, 2), "node", "distance") == [(1, 0), (2, 1), (3, 2)]
    pairs = spark.createDataFrame([(1, 4, 1), (1, 1, 9)], "graph int, a int, b int")
    assert rows(graphs.hop_distance(path_graph, pairs, 4), "a", "b", "length") == [(1, 9, None), (4, 1, 3)]
    cheap = spark.createDataFrame([(1, 1, 2, 0.1), (1, 2, 3, 0.1), (1, 1, 3, 0.9)], "graph int, src int, dst int, weight double")
    assert [r["nodes"] for r in graphs.weighted_paths(cheap, spark.createDataFrame([(1, 1, 3)], "graph int, a int, b int")).collect()] == [[1, 2, 3]]


def test_communities_of_two_triangles(spark):
    e = spark.createDataFrame([(1, a, b, 1.0) for a, b in [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]], "graph int, src int, dst int, weight double")
    assert rows(graphs.communities(e), "node", "community") == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)]


def test_last_writer_wins_on_typed_edges(spark):
    s = lambda *n: spark.createDataFrame([("d", i, 1, "S") for i in n], "doc_id string, node_id int, page int, section string")
    assert rows(edges.resolve(edges.structural_edges(s(0, 2))), "src", "dst", "type", "weight") == [(0, 2, "proximity", 0.5), (2, 0, "proximity", 0.5)]
    assert rows(edges.resolve(edges.structural_edges(s(0, 1))), "src", "dst", "type", "weight") == [(0, 1, "section", 0.6), (1, 0, "section", 0.6)]


def test_discourse_edges_take_the_last_type(spark):
    spans = spark.createDataFrame([("d", 0, 0, "if it must"), ("d", 1, 1, "x"), ("d", 2, 5, "y")], "doc_id string, node_id int, sentence_id int, text string")
    assert rows(edges.discourse_edges(spans), "src", "dst", "type", "weight") == [(0, 1, "requirement", 0.85)]


def test_repeated_entity_gives_a_self_loop(spark):
    n = spark.createDataFrame([("d", 0, ["x", "x"]), ("d", 1, ["x"])], "doc_id string, node_id int, entities array<string>")
    got = rows(edges.mention_pairs(edges.entity_mentions(n), "entity", 1), "src", "dst")
    assert got == [(0, 0), (0, 1), (1, 0)]


def test_thresholds_and_nearest_neighbours(spark):
    n = spark.createDataFrame([("d", i, [1.0, i / 10]) for i in range(6)] + [("d", 9, [0.0, 0.0])], "doc_id string, node_id int, embedding array<float>")
    sims = edges.similarities(n)
    assert sims.filter("src = 9 or dst = 9").agg(F.max("sim")).first()[0] == 0.0
    assert edges.semantic_edges(sims, floor=1.1).count() == 0
    knn = edges.knn_edges(sims, floor=0.1, quantile=0.0)
    assert knn.count() == knn.select("src", "dst").distinct().count()
    q = spark.createDataFrame([("d", float(v)) for v in (1, 2, 4, 8, 9)], "doc_id string, sim double")
    assert edges.dynamic_threshold(q, 0.85, 0.0).first()["threshold"] == 8.4


def test_overlap_guard(spark):
    df = spark.createDataFrame([([(0, 5), (3, 8), (8, 10)],)], "s array<struct<start: int, end: int>>")
    assert [tuple(x) for x in df.select(passages.keep_apart(F.col("s")).alias("k")).first()["k"]] == [(0, 5), (8, 10)]


def test_sentence_nodes_and_spans(spark):
    pages = spark.createDataFrame([("d", 1, "Big Title\nOne two. Three four."), ("d", 2, "Five six."), ("e", 1, "")], "doc_id string, page int, text string")
    got = rows(passages.sentence_nodes(pages), "doc_id", "node_id", "sent_index", "page", "section")
    assert got == [("d", 0, 0, 1, "Big Title"), ("d", 1, 1, 1, "Big Title"), ("d", 2, 0, 2, "Big Title")]
    named = spark.createDataFrame([("d", 1, 0, "Three", "X"), ("d", 1, 1, "four", "X"), ("d", 1, 2, "e fo", "X")], "doc_id string, node_id long, ord int, text string, label string")
    spans = passages.span_rows(passages.sentence_nodes(pages), named)
    assert rows(spans.filter("sentence_id = 1"), "ord", "span_type", "text") == [(0, "sentence", "Three four."), (1, "ner:X", "Three"), (2, "ner:X", "four")]


def test_hybrid_core_and_fusion_fixtures(spark):
    df = spark.createDataFrame([("q", i, *v) for i, v in enumerate([(0.2, 0.0, 0.1), (0.6, 2.0, 0.1), (0.4, 4.0, 0.1)])], "q_id string, span_id int, sem double, lex double, cent double")
    assert [round(r[1], 6) for r in rows(retrieval.weighted_combine(df), "span_id", "score")] == [0.0, 0.65, 0.55]
    core = spark.createDataFrame([("q", 1, 0.5, 0.0, 0.5, 0.4, 0.1, 1.0, 0.0, 1.0, 0.0, 2), ("q", 2, 0.5, 1.0, 0.5, 0.4, 0.1, 1.0, 0.0, 1.0, 0.0, 2)], "q_id string, span_id int, sem double, bm25 double, overlap double, sentence double, cent double, in_hybrid double, in_traversal double, in_expansion double, in_kg double, kg_hits int")
    assert dict(rows(retrieval.final_scores(core), "span_id", "score")) == {1: 0.344, 2: 0.524}
    lists = spark.createDataFrame([("q", "x", 0), ("q", "y", 1), ("q", "y", 0)], "q_id string, item string, r int")
    assert dict(rows(evaluation.rrf(lists, ["q_id"], "item", "r"), "item", "rrf")) == {"x": 1.0, "y": 1.5}


def test_mmr_prefers_new_directions(spark):
    df = spark.createDataFrame([("q", 1, 1, 1.0, [1.0, 0.0]), ("q", 2, 2, 0.9, [1.0, 0.0]), ("q", 3, 3, 0.5, [0.0, 1.0])], "q_id string, span_id int, rank int, score double, embedding array<double>")
    assert rows(retrieval.mmr(df, 2), "pick", "span_id") == [(1, 1), (2, 3)]
    assert rows(retrieval.mmr(df, 3), "pick", "span_id") == [(1, 1), (2, 2), (3, 3)]
    assert retrieval.diverse(df, 2).count() == 2


def test_questions(spark):
    def ask(column, q):
        return spark.createDataFrame([(q,)], "q string").select(column(F.col("q")).alias("x")).first()["x"]

    assert ask(questions.question_class, "who is the author") == "comparative"
    assert ask(questions.question_class, "Why did it fail") == "causal"
    assert ask(questions.comparison_type, "Are the Albuquerque International Sunport and the Charleston International Airport both located in the US?") == "boolean"
    long = "What is an IBA Official Cocktail composed of gin, dry Vermouth, orange bitters, maraschino and Absinthe, Staten Island Ferry or Tuxedo ?"
    assert tuple(ask(questions.comparison_sides, long)) == ("dry Vermouth, orange bitters, maraschino and Absinthe, Staten Island Ferry", "Tuxedo")
    assert ask(questions.comparison_type, long) == "select_one"
    first = "Which documentary came first, 10 Questions for the Dalai Lama or Bougainville – Our Island Our Fight?"
    assert ask(questions.comparison_type, first) == "comparative"
    assert tuple(ask(questions.comparison_sides, first)) == ("10 Questions for the Dalai Lama", "Bougainville – Our Island Our Fight")
    assert ask(questions.comparison_type, "What type of media does Mr Hudson and Makethisrelate have in common?") == "common_property"
    assert ask(lambda q: questions.sub_questions(q, F.lit("comparative")), "Are cats and dogs both pets?") == ["Is cats pets?", "Is dogs pets?"]
    assert ask(lambda q: questions.sub_questions(q, F.lit("factual")), "Are cats and dogs both pets?") == ["Are cats and dogs both pets?"]


def test_comparison_refinement(spark):
    schema = "q string, k string, a string, e1 string, e2 string, f array<string>, t1 array<string>, t2 array<string>"
    data = [
        ("Are A1 and B2 both cats?", "boolean", "maybe", "A1", "B2", ["A1 is not x", "B2 is not y"], ["a1"], ["b2"]),
        ("Are A1 and B2 both cats?", "boolean", "maybe", "A1", "B2", ["A1 cat", "B2 cat"], ["A1 cat"], ["B2 cat"]),
        ("Which came first, A1 or B2?", "comparative", "B2", "A1", "B2", [], ["made in 1950"], ["made in 1940"]),
        ("Which, Big Tower or Hall?", "select_one", "tower", "Big Tower", "Hall", [], ["x"], ["y"]),
        ("Is it?", "boolean", "Yes, it is", None, None, [], [], []),
    ]
    df = spark.createDataFrame(data, schema)
    got = [r["x"] for r in df.select(comparison.refine(*(F.col(c) for c in ("q", "k", "a", "e1", "e2", "f", "t1", "t2"))).alias("x")).collect()]
    assert got == ["no", "yes", "B2", "Big Tower", "yes"]


def test_knowledge_graph(spark):
    s = spark.createDataFrame([("d", 0, ["P:ann", "O:acme", "P:bob"]), ("d", 1, ["P:ann", "O:acme"])], "doc_id string, node_id int, entities array<string>")
    t = knowledge.valid_triples(knowledge.related_triples(s))
    e, n = knowledge.kg_edges(t), knowledge.kg_nodes(t)
    assert rows(e, "src", "dst", "relation", "weight") == [("acme", "bob", "related_to", 1.0), ("ann", "acme", "related_to", 2.0)]
    assert rows(n, "text", "label", "frequency") == [("acme", "O", 3), ("ann", "P", 2), ("bob", "entity", 1)]
    stats = knowledge.kg_stats(n, e, components=True).first()
    assert (stats["nodes"], stats["edges"], stats["density"], stats["connected"]) == (3, 2, 0.333333, True)
    paths = knowledge.bridge_entities(knowledge.path_evidence(e, spark.createDataFrame([("d", "bob", "ann")], "doc_id string, a string, b string"))).first()
    assert paths["steps"] == ["bob -[related_to]-> acme", "acme -[related_to]-> ann"] and paths["bridges"] == ["acme"]
    facts = knowledge.entity_facts(e, spark.createDataFrame([("d", "ann")], "doc_id string, start string")).first()["facts"]
    assert facts == ["ann related_to acme", "acme related_to bob"]


def test_reader_folding(spark):
    read = spark.createDataFrame([("q", 1, 1, "a", 0.3), ("q", 1, 2, "b", 0.4), ("q", 2, 1, "c", 0.45), ("q", 3, 1, "d", 0.48), ("q", 3, 2, "e", 0.52), ("r", 1, 1, "x", 0.01)], "q_id string, pass int, ord int, answer string, qa_score double")
    assert rows(answers.accept_reading(read), "q_id", "answer", "qa_score") == [("q", "e", 0.52)]


def test_samples_and_quotas(spark):
    assert sampling.quotas(7) == {("easy", "bridge"): 1, ("easy", "comparison"): 2, ("medium", "bridge"): 1, ("medium", "comparison"): 1, ("hard", "bridge"): 1, ("hard", "comparison"): 1}
    df = spark.createDataFrame([(str(i), lv, k) for i in range(9) for lv in sampling.LEVELS for k in sampling.KINDS], "q_id string, level string, type string")
    assert sampling.sample_questions(df, 7).count() == 7
    assert sampling.sample_level(df, "hard", 3).count() == 3


def test_question_json_pages_tables_and_sections(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"_id":"a","question":"q?","answer":"yes","type":"bridge","level":"easy","context":[["T 1",["s1. "," s2"]],["U",["x"]]]}]')
    q = documents.read_questions(spark, str(tmp_path / "q.json"))
    assert rows(documents.context_pages(q), "doc_id", "page", "text") == [("a", 1, "T 1\ns1. s2"), ("a", 2, "U\nx")]
    assert documents.context_prompt(q).first()["prompt"].startswith("[T 1]: s1. ")
    assert documents.context_sentences(q).count() == 3
    pages = spark.createDataFrame([("d", 1, "intro"), ("d", 2, "a | b\nc | d\ne"), ("d", 3, "x")], "doc_id string, page int, text string").withColumn("title", F.when(F.col("page") == 2, F.lit("T")))
    assert [r["rows"] for r in documents.text_tables(pages).collect()] == [[["a", "b"], ["c", "d"]]]
    assert rows(documents.sections(pages), "section_id", "title", "pages") == [(0, "Introduction", [1]), (1, "T", [2, 3])]


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("d", 1, "a<b", ["x", "y"])], "doc_id string, node_id int, text string, entities array<string>")
    e = spark.createDataFrame([("d", 1, 1, "t", 1.0)], "doc_id string, src int, dst int, type string, weight double")
    assert "x,y" in sinks.graphml(n, e).first()["graphml"] and "a&lt;b" in sinks.graphml(n, e).first()["graphml"]
    assert '"nodes"' in sinks.graph_json(n, e).first()["json"]
    rec = spark.createDataFrame([("a", 1), ("b", 101)], "q_id string, q_num int")
    sinks.append_checkpoint(rec, str(tmp_path / "c"))
    done = spark.read.parquet(str(tmp_path / "c"))
    assert rows(done, "q_id", "batch_id") == [("a", 0), ("b", 1)]
    assert sinks.remaining(rec, done.filter("q_id = 'a'")).count() == 1
    table = sinks.comparison_table(spark.createDataFrame([("s1", 0.5, None), ("s2", 0.25, 1.0)], "system string, em double, f1 double"), ["em", "f1"])
    assert rows(table, "metric", "s1", "s2") == [("em", "0.5000", "0.2500"), ("f1", "N/A", "1.0000")]


def test_model_plug_points(spark):
    df = spark.createDataFrame([("q", "p")], "question string, prompt string")
    loader = lambda: lambda xs: ["line one\nmore" for _ in xs]
    assert models.ask_model(df, loader, pause=0).first()["answer"] == "line one"
    assert len(df.select(models.embed(F.col("prompt")).alias("v")).first()["v"]) == models.WIDTH
    assert models.read_answers(df).first()["qa_score"] == 0.0
