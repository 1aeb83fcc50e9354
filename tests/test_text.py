"""Scalar functions on fixtures computed by hand."""

from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else 'array<float>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def c(name):
    return F.col(name)


def test_tokenize_keeps_accents_and_drops_combining_marks(spark):
    assert one(spark, X.tokenize(c("t")), t="éçran naïve x_1 कि") == ["éçran", "naïve", "x_1", "क"]


def test_normalize_answer(spark):
    assert one(spark, X.normalize_answer(c("t")), t=" The  Tuxedo. ") == "tuxedo"
    assert one(spark, X.normalize_answer(c("t")), t="Yes, they are.") == "yes they are"
    assert one(spark, X.normalize_answer(c("t")), t=None) == ""
    assert one(spark, X.normalize_answer(c("t")), t="") == ""


def test_sentences_and_clauses(spark):
    assert one(spark, X.sentences(c("t")), t="One two. Yes? No.  Three four!") == ["One two.", "Yes?", "Three four!"][:1] + ["Yes?", "Three four!"]
    assert one(spark, X.clauses(c("t")), t="a; b: C d: e") == ["a", "b", "C d: e"]


def test_pattern_entities_ignore_case_and_percent_needs_a_word_after(spark):
    found = one(spark, X.pattern_entities(c("t")), t="the cat sat. on Mat Bob")
    assert found == ["PERSON/ORG:the cat sat", "PERSON/ORG:on mat bob"]
    assert one(spark, X.pattern_entities(c("t"), patterns={"PERCENTAGE": L.ENTITY_PATTERNS["PERCENTAGE"]}), t="50% of 20%x 5%") == ["PERCENTAGE:20%"]


def test_discourse_types_match_inside_words(spark):
    assert one(spark, X.discourse_types(c("t")), t="if it must") == ["condition", "requirement"]
    assert "condition" in one(spark, X.discourse_types(c("t")), t="a specific thing")


def test_section_title(spark):
    for line, heading in [("1.2 Scope of work", True), ("General Provisions", True), ("ALL CAPS HERE", True), ("plain words here", False), ("One", False), ("A b", False)]:
        assert (one(spark, X.section_title(c("t")), t=line) is not None) == heading, line


def test_entity_and_year_helpers(spark):
    assert one(spark, X.normalize_entity(c("t")), t="The  their Big House") == "big house"
    assert one(spark, X.normalize_entity(c("t")), t="the a an") == ""
    assert one(spark, X.first_year(c("t")), t=["none 123", "in 1934 and 2001"]) == 1934
    assert one(spark, X.entity_match_score(c("a"), c("b")), a="Staten Ferry", b="Staten Island Ferry") == 2
    assert one(spark, X.clean_entity(c("t")), t="are the Catasetum") == "Catasetum"


def test_cosine_and_zero_norm(spark):
    assert abs(one(spark, X.cosine(c("a"), c("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - 0.5**0.5) < 1e-9
    assert one(spark, X.cosine(c("a"), c("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0


def test_fuzzy_overlap_and_truncate(spark):
    assert one(spark, X.fuzzy_overlap(c("a"), c("b")), a=["york", "cat"], b=["yorkshire", "cats"]) == 1
    assert one(spark, X.truncate_answer(c("t"), 20), t="Short.") == "Short."
    assert one(spark, X.truncate_answer(c("t"), 20), t="A first sentence. Then more words") == "A first sentence."
    assert one(spark, X.truncate_answer(c("t"), 20), t="no stop in here at all whatsoever") == "no stop in here at..."


def test_repairs(spark):
    assert one(spark, X.repair_null_interleaved(c("t")), t="a\x00b\x00¹5") == "ab₹5"
    assert one(spark, X.repair_null_interleaved(c("t")), t="¹5") == "¹5"
    assert one(spark, X.clean_page_text(c("t")), t="hyphen-\nated\nline") == "hyphenated line"
    assert one(spark, X.join_spaced_characters(c("t")), t="T o t a l is x y") == "Total is x y"


def test_weights_and_labels(spark):
    assert one(spark, X.semantic_weight(c("s")), s=0.75) == 0.25
    assert one(spark, X.confidence_label(c("s")), s=0.5) == "Med"
    assert one(spark, X.escape_html(c("t")), t="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, X.normalize_text_exact(c("t")), t="Straße ﬁ") == "strasse fi"
