"""Question classification, decomposition and comparison analysis as CASE chains and regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X


def question_class(q: Column) -> Column:
    """The first class one of whose words is in the lower-cased question (also inside words); else factual."""
    low = F.lower(q)
    out = None
    for kind, words in L.QUESTION_CLASSES:
        hit = X.contains_any(low, words)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("factual")


def _groups(x: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(x, pattern, k + 1) for k in range(n)]


def sub_questions(q: Column, kind: Column) -> Column:
    """Simpler questions of a compound one, by the first rule that fits; else the question alone."""
    clean = F.trim(F.replace(q, F.lit("?"), F.lit("")))
    ask = lambda *parts: F.concat(*parts, F.lit("?"))
    both = L.BOTH_SHARE
    e1, e2, prop = _groups(clean, both, 3)
    acts = L.TWO_ACTS
    wh, noun, a1, a2 = _groups(clean, acts, 4)
    choice = L.CHOICE
    _, adjective, c1, c2 = _groups(clean, choice, 4)
    for old, new in L.PLAIN_ADJECTIVE:
        adjective = F.replace(adjective, F.lit(old), F.lit(new))
    lacks = L.ONE_LACKS
    l1, action, l2 = _groups(clean, lacks, 3)
    bridge = L.BRIDGE
    halves = F.split(clean, " and ")
    splits = (F.size(halves) == 2) & (X.word_count(F.get(halves, F.lit(0))) > 2) & (X.word_count(F.get(halves, F.lit(1))) > 2)
    rules = (
        F.when(clean.rlike(both), F.array(F.concat(F.lit("Is "), ask(e1, F.lit(" "), prop)), F.concat(F.lit("Is "), ask(e2, F.lit(" "), prop))))
        .when(clean.rlike(acts), F.array(ask(wh, noun, F.lit(" "), a1), ask(wh, noun, F.lit(" "), a2)))
        .when(clean.rlike(choice), F.array(F.concat(F.lit("How "), ask(adjective, F.lit(" is "), c1)), F.concat(F.lit("How "), ask(adjective, F.lit(" is "), c2))))
        .when(clean.rlike(lacks), F.array(F.concat(F.lit("What "), ask(action, F.lit(" for "), l1)), F.concat(F.lit("What "), ask(action, F.lit(" for "), l2))))
        .when(clean.rlike(bridge), F.array(F.concat(F.lit("What is "), ask(F.regexp_extract(clean, bridge, 1))), q))
        .when(splits, F.transform(halves, lambda h: F.concat(F.trim(h), F.lit("?"))))
        .otherwise(F.array(q))
    )
    return F.when(kind.isin(L.DECOMPOSED), rules).otherwise(F.array(q))


def is_complex(parts: Column) -> Column:
    return F.size(parts) > 1


def comparison_type(q: Column) -> Column:
    low = F.trim(F.lower(q))
    return (
        F.when(X.matches_any(low, L.DIFFERENCE), "difference")
        .when(X.matches_any(low, L.COMMON_PROPERTY, ignore_case=True), "common_property")
        .when(X.matches_any(low, L.BOOLEAN), "boolean")
        .when(X.matches_any(low, L.COMPARATIVE), "comparative")
        .otherwise("select_one")
    )


def comparison_sides(q: Column) -> Column:
    """struct<first, second> by the first pattern that fits; null fields if none does."""
    comma = F.instr(q, ",")
    read = {
        "question": q,
        "after_comma": F.when(comma > 0, F.regexp_replace(F.trim(F.substr(q, comma + 1)), "\\?+$", "")),
        "stripped": X.strip_question_prefix(q),
    }
    sides = []
    for source, pattern in L.COMPARISON_SIDES:
        x = read[source]
        sides.append(F.when(x.rlike(pattern), F.struct(*(F.trim(F.regexp_extract(x, pattern, k)).alias(n) for k, n in ((1, "first"), (2, "second"))))))
    none = F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"))
    return F.coalesce(*sides, none)
