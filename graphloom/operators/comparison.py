"""Refining the answers of comparison questions from facts and evidence texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X


def negation_count(x: Column) -> Column:
    """Matches of the negation patterns in a lower-cased text."""
    total = F.lit(0)
    for p in L.NEGATIONS:
        total = total + F.regexp_count(x, F.lit(p))
    return total


def boolean_vote(facts: Column, first: Column, second: Column, question: Column) -> Column:
    """`no` from two negations on; `yes` if a both-word is asked, both sides are in the facts and nothing is negated; else null."""
    joined = F.lower(F.array_join(facts, " "))
    n = negation_count(joined)
    present = F.contains(joined, F.lower(first)) & F.contains(joined, F.lower(second))
    asks = X.contains_any(F.lower(question), L.BOTH_WORDS)
    return F.when(n >= 2, "no").when(asks & present & (n == 0), "yes")


def boolean_answer(answer: Column, vote: Column, evidence1: Column, evidence2: Column, first: Column, second: Column) -> Column:
    """The vote, else strong or soft negation, else both sides present, else the answer."""
    e1, e2 = F.lower(F.array_join(evidence1, " ")), F.lower(F.array_join(evidence2, " "))
    both = F.concat_ws(" ", e1, e2)
    negative = X.contains_any(both, L.STRONG_NEGATIVES) | e1.rlike(L.SOFT_NEGATIVE) | e2.rlike(L.SOFT_NEGATIVE)
    present = F.contains(both, F.lower(first)) & F.contains(both, F.lower(second))
    return F.when(vote.isNotNull(), vote).when(negative, "no").when(present, "yes").otherwise(answer)


def strict_boolean(answer: Column, evidence: Column | None = None) -> Column:
    """`yes` or `no` by the word in the answer; else by negative hits in the evidence; `no` where there is none to read."""
    form = X.comparison_form(answer)
    rest = F.lit("no")
    if evidence is not None:
        rest = F.when(X.contains_any(F.concat(F.lit(" "), F.lower(evidence), F.lit(" ")), L.NEGATIVE_HITS), "no").otherwise("yes")
    return F.when(form.rlike("\\byes\\b"), "yes").when(form.rlike("\\bno\\b"), "no").otherwise(rest)


def expand_partial(answer: Column, first: Column, second: Column) -> Column:
    """A partial answer becomes the compared side that contains it and is longer, the first side first."""
    low = F.lower(answer)
    inside = lambda e: F.contains(F.lower(e), low) & (F.length(e) > F.length(answer))
    usable = (low != "") & ~low.isin("yes", "no", L.NO_ANSWER.lower())
    return F.when(usable & inside(first), first).when(usable & inside(second), second).otherwise(answer)


def year_choice(question: Column, answer: Column, first: Column, second: Column, year1: Column, year2: Column) -> Column:
    """The side with the earlier or later year if the question asks for one and both years are known."""
    low = F.lower(question)
    earliest, latest = X.contains_any(low, L.FIRST_WORDS), X.contains_any(low, L.RECENT_WORDS)
    known = (earliest | latest) & year1.isNotNull() & year2.isNotNull()
    return F.when(known, F.when((earliest & (year1 < year2)) | (latest & (year1 > year2)), first).otherwise(second)).otherwise(answer)


def choose_side(answer: Column, first: Column, second: Column, support1: Column, support2: Column) -> Column:
    """The side that matches the trimmed answer better; on a tie the one with more supporting texts, the first if equal."""
    a = X.trim_answer(answer)
    s1, s2 = X.entity_match_score(a, first), X.entity_match_score(a, second)
    return F.when(s1 > s2, first).when(s2 > s1, second).when(support1 >= support2, first).otherwise(second)


def refine(question: Column, kind: Column, answer: Column, first: Column, second: Column, facts: Column, evidence1: Column, evidence2: Column, years: bool = True, strict: bool = True) -> Column:
    """The refined answer. Without both sides only boolean answers change; `years` and `strict` switch those rules off."""
    answer = F.coalesce(answer, F.lit(""))
    e1, e2 = X.clean_entity(first), X.clean_entity(second)
    vote = boolean_vote(facts, e1, e2, question)
    as_boolean = boolean_answer(answer, vote, evidence1, evidence2, e1, e2)
    as_other = expand_partial(answer, e1, e2)
    if years:
        as_other = F.when(kind == "comparative", year_choice(question, as_other, e1, e2, X.first_year(evidence1), X.first_year(evidence2))).otherwise(as_other)
    if strict:
        as_boolean = strict_boolean(as_boolean, F.concat_ws(" ", F.array_join(evidence1, " "), F.array_join(evidence2, " ")))
        as_other = F.when(kind.isin("comparative", "select_one"), choose_side(as_other, e1, e2, F.size(evidence1), F.size(evidence2))).otherwise(as_other)
    known = first.isNotNull() & second.isNotNull() & (first != "") & (second != "")
    alone = F.when((kind == "boolean") & ~F.lower(answer).isin("yes", "no"), strict_boolean(answer)).otherwise(answer)
    return F.when(known, F.when(kind == "boolean", as_boolean).otherwise(as_other)).otherwise(alone)
