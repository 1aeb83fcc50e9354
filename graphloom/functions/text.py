"""Text normalisation and scalar functions as Column expressions: they stay in generated JVM code.

Where Spark has no expression with the exact semantics (compatibility normalisation, case folding, title case)
an Arrow UDF is offered beside the built-in form.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions import lexicons as L

WORD = "([\\p{L}\\p{N}_]+)"
PUNCTUATION = "[!-/:-@\\[-`{-~]"
SENTENCE_END = "(?<=[.!?।॥])\\s+"


def bind(use, **values: Column) -> Column:
    """use(row) with each value computed once: expressions inside a higher-order function's lambda run for every element."""
    row = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.get(F.transform(row, use), F.lit(0))


def squeeze(x: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def normalize_text(x: Column) -> Column:
    """Retrieval form: danda marks as full stops, lower case, squeezed."""
    return squeeze(F.lower(F.translate(x, "।॥", "..")))


@F.pandas_udf(StringType())
def normalize_text_exact(x: pd.Series) -> pd.Series:
    """As normalize_text with compatibility normalisation and full case folding."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).replace("।", ".").replace("॥", ".").casefold().split()))


def tokenize(x: Column) -> Column:
    """Unicode words of the normalised text."""
    return F.regexp_extract_all(normalize_text(x), F.lit(WORD), 1)


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, squeezed."""
    bare = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, "\\b(a|an|the)\\b", " "))


def answer_tokens(x: Column) -> Column:
    return F.filter(F.split(normalize_answer(x), " "), lambda t: t != "")


def strip_section_prefix(x: Column) -> Column:
    """Drops a leading section number such as `2.1 `."""
    return F.regexp_replace(x, "^\\d+(?:\\.\\d+)*\\s+", "")


def repair_null_interleaved(x: Column) -> Column:
    """Text whose characters alternate with NUL loses the NULs; only then a superscript one before a digit is a rupee sign."""
    nul = F.lit("\x00")
    return F.when(F.contains(x, nul), F.regexp_replace(F.replace(x, nul, F.lit("")), "¹(?=\\d)", "₹")).otherwise(x)


def join_spaced_characters(x: Column) -> Column:
    """Runs of four or more single characters set apart by spaces become words; currency signs rejoin their number."""
    gaps = F.regexp_replace(x, "(?<=(?:^|\\s)\\S) (?=\\S(?:\\s|$))", "\x01")
    # a gap is closed only inside a run of at least four characters
    closed = F.regexp_replace(gaps, "(?<=[^\\s\x01]\x01[^\\s\x01]\x01[^\\s\x01])\x01(?=[^\\s\x01])|(?<=[^\\s\x01])\x01(?=[^\\s\x01]\x01[^\\s\x01]\x01[^\\s\x01])|(?<=[^\\s\x01]\x01[^\\s\x01])\x01(?=[^\\s\x01]\x01[^\\s\x01])", "")
    return F.regexp_replace(F.replace(closed, F.lit("\x01"), F.lit(" ")), "([₹$€£])\\s+(?=\\d)", "$1")


def clean_page_text(x: Column) -> Column:
    """Repairs, joins words hyphenated over lines, and turns line breaks into spaces."""
    joined = F.regexp_replace(join_spaced_characters(repair_null_interleaved(x)), "(\\w)-\\s*\\n\\s*(\\w)", "$1$2")
    return squeeze(F.regexp_replace(joined, "\\n+", " "))


def sentences(x: Column, longer_than: int = 3) -> Column:
    """Trimmed sentences of more than `longer_than` characters."""
    parts = F.transform(F.split(x, SENTENCE_END), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def clauses(x: Column) -> Column:
    """A sentence cut at semicolons and at colons before a capital."""
    return F.split(x, ";\\s+|:\\s+(?=[A-Z])")


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(x), "\\s+"), lambda t: t != ""))


def section_title(line: Column) -> Column:
    """The line if it looks like a heading: numbered, title case of at most 8 words or capitals of 2 to 9; else null."""
    s = F.trim(line)
    words = word_count(s)
    letters = F.regexp_replace(s, "[^\\p{L}]", "")
    # every letter run starts upper and goes on lower
    title = (letters != "") & ~s.rlike("(^|[^\\p{L}])\\p{Ll}") & ~s.rlike("\\p{L}\\p{Lu}")
    capitals = (letters != "") & (F.upper(s) == s) & ~s.rlike("\\p{Ll}")
    numbered = s.rlike("^\\d+(\\.\\d+)*\\.?\\s+\\p{L}")
    heading = numbered | (title & (words <= 8)) | (capitals & words.between(2, 9))
    return F.when((F.length(s) >= 4) & (words >= 2) & heading, s)


def normalize_entity(x: Column) -> Column:
    """Knowledge-graph form: lower case, squeezed, without leading stop words; empty if nothing is left."""
    stops = "|".join(L.ENTITY_STOP)
    return F.regexp_replace(squeeze(F.lower(x)), f"^(?:(?:{stops})(?:\\s+|$))+", "")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def semantic_weight(sim: Column, threshold: float = 0.5) -> Column:
    """Squared excess over the threshold, 0 below it."""
    return F.when(sim < threshold, 0.0).otherwise(F.pow((sim - threshold) / (1 - threshold), 2))


def structural_weight(same_sentence: Column, same_section: Column, same_page: Column, distance: Column) -> Column:
    """The closest shared level plus a bonus for near ids, at most 1."""
    level = F.when(same_sentence, 1.0).when(same_section, 0.5).when(same_page, 0.3).otherwise(0.0)
    near = F.when(distance == 1, 0.8).when(distance == 2, 0.4).otherwise(0.0)
    return F.least(F.lit(1.0), level + near)


def discourse_types(x: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Types with a marker anywhere in the lower-cased text (also inside words), in lexicon order."""
    low = F.lower(x)
    tests = []
    for kind, markers in (lexicon or L.DISCOURSE).items():
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(low, F.lit(m))
        tests.append(F.when(hit, F.lit(kind)))
    return F.array_compact(F.array(*tests))


def discourse_weight(a: Column, b: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """0.4 for each type found as words in both texts, 0.15 in one, at most 1."""
    total = F.lit(0.0)
    for markers in (lexicon or L.DISCOURSE).values():
        pattern = r"\b(?:" + "|".join(map(re.escape, markers)) + r")\b"
        n = F.lower(a).rlike(pattern).cast("int") + F.lower(b).rlike(pattern).cast("int")
        total = total + F.when(n == 2, 0.4).when(n == 1, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), total)


#: The same matches as the fixed pattern's without backtracking, which in the JVM recurses once a word of a long text.
PERSON_JVM = r"\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++"


def pattern_entities(x: Column, ignore_case: bool = True, patterns: dict[str, str] | None = None) -> Column:
    """`TYPE:match` in lower case for every match of every pattern, repeats kept."""
    flag = "(?i)" if ignore_case else ""

    def named(kind: str, pattern: str) -> Column:
        pattern = PERSON_JVM if pattern == L.ENTITY_PATTERNS["PERSON/ORG"] else pattern
        return F.transform(F.regexp_extract_all(x, F.lit(f"{flag}({pattern})"), 1), lambda m: F.concat(F.lit(f"{kind}:"), F.lower(m)))

    return F.concat(*(named(kind, p) for kind, p in (patterns or L.ENTITY_PATTERNS).items()))


def fuzzy_overlap(query: Column, target: Column) -> Column:
    """Query tokens that are in the target, or of which one is the other's prefix and both have 4 characters."""

    def near(q, t):
        return (q == t) | ((F.length(q) >= 4) & (F.length(t) >= 4) & (F.startswith(q, t) | F.startswith(t, q)))

    return bind(lambda r: F.size(F.filter(r["q"], lambda q: F.exists(r["t"], lambda t: near(q, t)))), q=query, t=target)


def comparison_form(x: Column) -> Column:
    """Lower case with runs of other than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def trim_answer(x: Column) -> Column:
    """Without quotes, brackets and punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), "^[\\s\"'“”‘’()\\[\\]{}.,;:!?]+", ""), "[\\s\"'“”‘’()\\[\\]{}.,;:!?]+$", "")


def clean_entity(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, L.ENTITY_NOISE, ""))


def entity_match_score(answer: Column, entity: Column) -> Column:
    """5 where one contains the other, plus the shared distinct words."""
    a, e = comparison_form(answer), comparison_form(entity)
    shared = F.size(F.array_intersect(F.split(a, " "), F.split(e, " ")))
    inside = F.contains(a, e) | F.contains(e, a)
    return F.when((a == "") | (e == ""), 0).otherwise(F.when(inside, 5).otherwise(0) + shared)


def year_in(x: Column) -> Column:
    """The first year from 1800 to 2099, or null."""
    y = F.regexp_extract(x, "\\b(1[89]\\d{2}|20\\d{2})\\b", 1)
    return F.when(y != "", y.cast("int"))


def first_year(texts: Column) -> Column:
    """The first year in the first text that has one."""
    return F.try_element_at(F.filter(F.transform(texts, year_in), lambda y: y.isNotNull()), F.lit(1))


def strip_question_prefix(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, L.QUESTION_PREFIX, ""))


def truncate_answer(x: Column, most: int) -> Column:
    """At most `most` characters: to the last full stop beyond 60 %, else to the last whole word and an ellipsis."""
    cut = F.substring(x, 1, most)
    back = F.reverse(cut)
    dot_at = most + 1 - F.least(*(F.when(F.instr(back, m) > 0, F.instr(back, m)).otherwise(most + 1) for m in (".", "।")))
    space = F.instr(back, " ")
    word = F.when(space > 0, F.substr(cut, F.lit(1), most - space)).otherwise(cut)
    whole = F.when(dot_at - 1 > 0.6 * most, F.substr(cut, F.lit(1), dot_at)).otherwise(F.concat(F.rtrim(word), F.lit("...")))
    return F.when(F.length(x) <= most, x).otherwise(whole)


def confidence_label(x: Column) -> Column:
    return F.when(x >= 0.8, "High").when(x >= 0.45, "Med").otherwise("Low")


def blend_confidence(retrieval: Column, qa: Column) -> Column:
    """0.4 of the clipped retrieval score and 0.6 of the reader's."""
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return clip(0.4 * clip(retrieval) + 0.6 * clip(qa))


def fact(subject: Column, relation: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, relation, object_)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def contains_any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def matches_any(x: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    return x.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))
