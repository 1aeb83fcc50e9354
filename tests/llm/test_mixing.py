"""Mixing: margins against targets at production parameters, topics against a plain count, SQL, odd rows."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, registry

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\W\d_]{5,}", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def reached(out):
    rows = [(r["source"], r["lang"], r["topic"], r["tokens"], r["prob"]) for r in out.collect()]
    shares = []
    for k in range(3):
        have, want = Counter(), Counter()
        for r in rows:
            have[r[k]] += r[3]
            want[r[k]] += r[3] * r[4]
        shares.append(({v: n / sum(have.values()) for v, n in have.items()}, {v: n / sum(want.values()) for v, n in want.items()}))
    return shares


def test_every_margin_is_at_its_target_with_production_parameters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (natural, expected), m in zip(reached(mixing.mixture(docs)), mixing.MARGINS, strict=True):
        raw = {v: s ** mixing.POWERS[m] if s else 0 for v, s in natural.items()}
        for v, s in raw.items():
            assert abs(expected[v] / (s / sum(raw.values())) - 1) < 2e-3, (m, v)


def test_explicit_targets_are_reached_and_reported(docs):
    want = {"en": 4.0, "fr": 3.0, "de": 2.0, "es": 1.0}
    (_, (_, lang), _) = reached(mixing.mixture(docs.withColumn("kind", F.lit("k")), targets={"lang": want}, topic_col="kind"))
    assert all(abs(lang[v] - w / 10) < 1e-3 for v, w in want.items())
    base = docs.select(*(F.col(c) for c in ("source", "lang")), F.lit("t").alias("topic"), F.length("text").alias("tokens"))
    report = mixing.margins(mixing.cell_probabilities(base, targets={"lang": {"en": 1.0, "fr": 1.0}})).collect()
    assert {r["value"]: round(r["expected"], 3) for r in report if r["margin"] == "lang"} == {"en": 0.5, "fr": 0.5, "de": 0.0, "es": 0.0}
    assert all(abs(r["target"] - r["expected"]) < 1e-3 for r in report)


def test_targets_that_contradict_each_other_end_and_are_reported(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 12)
    base = spark.createDataFrame([("a", "en", "t", 100), ("b", "fr", "t", 100)], "source string, lang string, topic string, tokens long")
    cells = mixing.cell_probabilities(base, targets={"source": {"a": 1.0, "b": 3.0}, "lang": {"en": 3.0, "fr": 1.0}})
    report = {(r["margin"], r["value"]): (r["target"], r["expected"]) for r in mixing.margins(cells).collect()}
    assert report[("source", "a")][0] == 0.25 and any(abs(t - e) > 0.1 for t, e in report.values())
    assert cells.filter("prob < 0 or prob > 1").isEmpty()


def test_topics_are_the_words_that_a_text_has_most(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    words, texts = mixing.topic_words(docs), {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    df = Counter(w for t in texts.values() for w in set(plain_words(t)))
    assert words == sorted((w for w, n in df.items() if n * mixing.COMMON <= len(texts)), key=lambda w: (-df[w], w))[: mixing.TOPICS]
    for r in mixing.mixture(docs).collect():
        n = Counter(plain_words(texts[r["doc_id"]]))
        best = max(words, key=lambda w: (n[w], -words.index(w)))
        assert r["topic"] == (best if n[best] else "other" if texts[r["doc_id"]] else "empty")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = ["doc_id", "source", "lang", "topic", "tokens", "prob", "sampled"]
    want = con.sql(f"select {', '.join(columns)} from ({mixing.oracle_sql()})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in registry.op10_mixing(spark, SF).select(columns).collect())


def test_the_sample_follows_probabilities_and_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    out = mixing.mixture(docs)
    picked, expected = out.agg(F.sum(F.when(F.col("sampled"), F.col("tokens"))), F.sum(F.col("tokens") * F.col("prob"))).first()
    assert abs(picked / expected - 1) < 0.15
    assert {r["doc_id"] for r in out.filter("sampled").collect()} == {r["doc_id"] for r in mixing.mix_documents(docs).collect()}
    odd = spark.createDataFrame([(1, "", "en", "a", "x"), (2, None, None, None, None), (None, "some words stand here", "en", "a", "x"), (3, "long " * 30000, "en", "b", "y"), (4, "twice", "en", "a", "x"), (4, "twice", "en", "a", "x")], "doc_id long, text string, lang string, source string, prob string")
    rows = mixing.mixture(odd).collect()
    assert len(rows) == 6 and {(r["source"], r["lang"], r["topic"], r["prob"]) for r in rows if r["doc_id"] == 2} == {("(none)", "(none)", "empty", 1.0)}
    assert mixing.mixture(odd, topic_col="prob").filter("doc_id = 2").first()["topic"] == "(none)"
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mixture(odd.limit(0)).count() == mixing.mix_documents(odd.limit(0)).count() == 0
