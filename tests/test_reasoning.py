"""The composed runs on small fixtures."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.operators import reasoning

TEXT = "The Nile is a long river in Egypt. It flows north to the sea. However the Amazon carries more water. Paris is the capital of France. The tower stands in Paris unless it is moved."


def embedding():
    def bag(text):
        """A plain embedding: counts of words by a small hash."""
        v = [0.0] * 32
        for w in text.lower().replace(".", "").replace("?", "").split():
            v[sum(map(ord, w)) % 32] += 1
        return v

    return bag


bag = embedding()  # made in a function, so that workers get it by value


@pytest.fixture(scope="module")
def corpus(spark):
    sentences = [s.strip() + "." for s in TEXT.split(".") if s.strip()]
    spans = [("d", i, i, s, "GLOBAL", bag(s), 0.1 * i) for i, s in enumerate(sentences)]
    return reasoning.Corpus(
        spark.createDataFrame(spans, "doc_id string, span_id long, sentence_id long, text string, section string, embedding array<double>, centrality double"),
        spark.createDataFrame([("d", i, s, bag(s), 0.2) for i, s in enumerate(sentences)], "doc_id string, sentence_id long, text string, embedding array<double>, pagerank double"),
        spark.createDataFrame([("d", 0, 1, "condition"), ("d", 3, 4, "temporal")], "doc_id string, src long, dst long, type string"),
        spark.createDataFrame([("d", i, i + 1, 1.0) for i in range(4)], "doc_id string, src long, dst long, weight double"),
        spark.createDataFrame([("d", "paris", "france"), ("d", "nile", "egypt")], "doc_id string, src string, dst string"),
    )


def ask(spark, *rows):
    return spark.createDataFrame([(q, "d", text, bag(text)) for q, text in rows], "q_id string, doc_id string, question string, embedding array<double>")


def test_core_ranks_the_spans_that_answer(spark, corpus):
    evidence, chains = reasoning.run_core(ask(spark, ("a", "Where is the Nile river"), ("b", "Name the capital of France")), corpus, 3)
    rows = {(r["q_id"], r["rank"]): r for r in evidence.collect()}
    assert len(rows) == 6 and rows[("a", 1)]["span_id"] == 0 and rows[("b", 1)]["span_id"] == 3
    assert rows[("b", 1)]["in_kg"] == 1.0 and rows[("a", 1)]["relevant"]
    order = [rows[("a", k)]["relevant"] for k in (1, 2, 3)]
    assert order == sorted(order, reverse=True)  # others fill up after the relevant ones
    found = chains.collect()
    assert found and all(r["rank"] <= 3 for r in found) and {r["type"] for r in found} <= {"drg_path", "kg_bridge"}


def test_compound_questions_are_asked_in_parts_and_summed(spark, corpus):
    evidence, _ = reasoning.reason(ask(spark, ("c", "Are the Nile and the Amazon both rivers?"), ("s", "Name the capital of France")), corpus, 3)
    rows = evidence.collect()
    parts = {r["q_id"]: r["parts"] for r in rows}
    assert parts == {"c": 2, "s": 1}
    scores = [r["score"] for r in sorted((r for r in rows if r["q_id"] == "c"), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)
    alone, _ = reasoning.run_core(ask(spark, ("s", "Name the capital of France")), corpus, 3)
    assert {(r["span_id"], r["rank"]) for r in alone.collect()} == {(r["span_id"], r["rank"]) for r in rows if r["q_id"] == "s"}


def test_span_graph_resolves_families_in_order(spark):
    spans = spark.createDataFrame([("d", 0, 0, "if x", ["ann"]), ("d", 1, 0, "y", ["ann"]), ("d", 2, 1, "z", []), ("d", 3, 2, "w", [])], "doc_id string, node_id long, sentence_id long, text string, entities array<string>")
    sims = spark.createDataFrame([("d", 0, 2, 0.9), ("d", 2, 3, 0.1)], "doc_id string, src long, dst long, sim double")
    aligned = spark.createDataFrame([("d", 2, ["bob"]), ("d", 3, ["bob"])], "doc_id string, node_id long, kg_entities array<string>")
    got = {(r["src"], r["dst"]): r["type"] for r in reasoning.span_graph(spans, sims, aligned).collect()}
    assert got[(0, 1)] == got[(1, 0)] == "entity_overlap"  # over condition, over same_sentence
    assert got[(0, 2)] == "condition" and got[(2, 0)] == "semantic" and got[(2, 3)] == got[(3, 2)] == "kg_overlap"
    kinds = {r["type"]: r["n"] for r in reasoning.edge_types(reasoning.span_graph(spans, sims, aligned)).collect()}
    assert sum(kinds.values()) == len(got)


def test_pages_to_answers(spark):
    pages = spark.createDataFrame([("d", 1, TEXT), ("e", 1, "Nothing to see here at all.")], "doc_id string, page int, text string")
    asked = spark.createDataFrame([("a", "d", "Name the capital of France"), ("z", "nowhere", "Who?")], "q_id string, doc_id string, question string")
    embed = F.udf(bag, "array<double>")
    out = {r["q_id"]: r["answer"] for r in reasoning.answer_questions(pages, asked, 3, embed).collect()}
    assert out == {"a": "Paris is the capital of France.", "z": L.NO_ANSWER}
    read = reasoning.answer_questions(pages, asked, 3, embed, lambda: lambda pairs: [("Paris", 0.9) for _ in pairs])
    assert {r["q_id"]: r["answer"] for r in read.collect()}["a"] == "Paris"


def test_evaluation_and_comparison(spark):
    gold = spark.createDataFrame([(1, "Paris", "easy", "bridge"), (2, "the Nile", "hard", "bridge")], "q_id int, answer string, level string, type string")
    each, means = reasoning.evaluate(spark.createDataFrame([(1, "paris")], "q_id int, answer string"), gold)
    assert {r["q_id"]: r["exact_match"] for r in each.collect()} == {1: 1.0, 2: 0.0}
    assert {r["questions"]: r["exact_match"] for r in means.filter("grouping = 3").collect()} == {2: 0.5}
    systems = spark.createDataFrame([("x", 1, "Paris"), ("x", 2, "Nile"), ("y", 1, "Rome")], "system string, q_id int, answer string")
    assert {(r["system"], r["exact_match"], r["answered"]) for r in reasoning.compare_systems(systems, gold).collect()} == {("x", 1.0, 2), ("y", 0.0, 1)}


def test_triples_and_phrases_by_rules(spark):
    from graphloom.operators import knowledge, passages

    rows = [("d", 0, "Hamlet was written... Hamlet was penned by William Shakespeare.", []), ("d", 1, "Marie Curie worked in Paris.", []), ("d", 2, "Paris is a large city, they say.", []), ("d", 3, "nothing here", ["X:ann", "X:bob"])]
    s = spark.createDataFrame(rows, "doc_id string, node_id long, text string, entities array<string>")
    got = {(r["subject"], r["relation"], r["object"]) for r in knowledge.rule_triples(s).collect()}
    assert {("William Shakespeare", "is penned by", "Hamlet"), ("Marie Curie", "worked in", "Paris"), ("Paris", "is", "large city"), ("ann", "related_to", "bob")} <= got
    assert not any(r == "is" and o.startswith("penned by") for _, r, o in got)
    t = spark.createDataFrame([("d", 0, "Marie Curie kept 12 small tubes and was awarded two large prizes, it is said")], "doc_id string, node_id long, text string")
    spans = {(r["span_type"], r["text"], r["start_char"], r["end_char"]) for r in passages.phrase_spans(t).collect()}
    assert {("noun_phrase", "Marie Curie", 0, 11), ("noun_phrase", "12 small tubes", 17, 31), ("verb_clause", "was awarded two large prizes", 36, 64)} <= spans
    assert all(len(text.split()) > 2 for kind, text, *_ in spans if kind == "verb_clause")


def test_paths_between_asked_names_have_any_length(spark):
    from graphloom.operators import knowledge

    e = spark.createDataFrame([("d", f"n{i}x", f"n{i + 1}x", "to", 1.0) for i in range(9)], "doc_id string, src string, dst string, relation string, weight double")
    n = spark.createDataFrame([("d", f"n{i}x", 0.1) for i in range(10)], "doc_id string, text string, pagerank double")
    asked = spark.createDataFrame([("d", "N0X", "n9"), ("d", "n1x", "zebra")], "doc_id string, first string, second string")
    out = knowledge.resolved_paths(n, e, asked).collect()
    assert len(out) == 1 and len(out[0]["nodes"]) == 10 and out[0]["steps"][0] == "n0x -[to]-> n1x"


def test_level_rows_fall_back_to_records_and_tables_are_written(spark, tmp_path):
    from graphloom.sources import sinks

    records = spark.createDataFrame([("a", "easy", 1.0, 1.0), ("a", "easy", 0.0, 0.5), ("b", "hard", 1.0, 1.0)], "system string, level string, exact_match double, f1 double")
    own = spark.createDataFrame([("b", "hard", 7, 0.3, 0.4)], "system string, level string, questions long, exact_match double, f1 double")
    assert {tuple(r) for r in sinks.level_rows(records, own).collect()} == {("a", "easy", 2, 0.5, 0.75), ("b", "hard", 7, 0.3, 0.4)}
    table = sinks.comparison_table(own.groupBy("system").agg(F.max("f1").alias("f1"), F.lit(None).cast("double").alias("em")), ["f1", "em"])
    sinks.write_comparison(table, str(tmp_path / "t"))
    assert any("N/A" in r["value"] for r in spark.read.text(str(tmp_path / "t/text")).collect())


def test_eigenvector_falls_back_where_it_does_not_settle(spark):
    from graphloom.operators import graphs

    e = spark.createDataFrame([("g", a, b, 1.0) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))] + [("h", 0, 1, 1.0)], "graph string, src long, dst long, weight double")
    got = {(r["graph"], r["node"]): r["centrality"] for r in graphs.eigenvector_or_pagerank(e, 60).collect()}
    assert abs(got[("g", 1)] / got[("g", 0)] - 2**0.5) < 1e-3
    assert got[("h", 1)] > got[("h", 0)] > 0
