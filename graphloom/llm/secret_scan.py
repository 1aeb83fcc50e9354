"""Secret scans by dictionary-primed zstandard novelty.

Strings of three fixed shapes (the base kinds) are always reported. Besides, a string that stands in a
sensitive context (after a word such as credential or bearer and an assignment or space) is a candidate. For
each candidate the scan measures its marginal compressed bytes: the zstandard size of the code around it
with the candidate in it, less the size without, with a compressor primed by a dictionary of identifiers,
key words and common word parts. Words and identifiers cost few bytes a character; random key material can't
be compressed below the entropy of its alphabet. A candidate is reported as `novel` if it mixes letters and
digits, its novelty, marginal bytes a character, is at least NOVELTY of its own alphabet's entropy, and it isn't
made of word parts: new identifiers cost as much as keys, but nearly all their letter pairs occur in the dictionary.
Candidates have any length; only those that fixed shapes hold whole aren't measured, as they are reported already.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from graphloom.llm.common import prepare, settle

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that make what follows them sensitive.
SENSITIVE = ("credential", "passphrase", "private_key", "privatekey", "access_key", "accesskey", "client_secret", "bearer", "authorization", "auth_token", "signing_key", "encryption_key", "pwd", "secret", "token", "password", "passwd", "apikey", "api_key", "api-key")
CANDIDATE = re.compile(r"""(?:%s)s?["'`]?[\x20\t]*(?::=|=>|[:=]|\x20)?[\x20\t]*["'`]?([A-Za-z0-9+/_=~.!@#%%^&*-]{16,})""" % "|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
#: Share of its alphabet's entropy from which a candidate's marginal compressed bytes count as random.
NOVELTY, AROUND = 0.9, 96
#: From so many letter pairs on, a candidate with over this share of known pairs is made of word parts.
WORD_PAIRS, WORDLIKE = 6, 0.8
PRIMER = zstandard.ZstdCompressionDict(
    (
        "public static void private protected final class import from return function const let var def self this null true false None async await "
        "username user_name hostname database connection endpoint config settings environment request response header content-type application/json "
        "https://www.example.com/index.html http://localhost:8080/api/v1/users/ aws_region access_key_id secret_access_key client_id client_secret "
        "password = passwd: token: api_key = apikey secret: authorization: bearer basic credentials private_key public_key signing_key encryption_key "
        "your_password_here change_me placeholder example_token xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
        "getInstance setValue toString initialize configuration authentication authorization implementation documentation description information "
        "the and of to in is that for with as was on are be this have from or had by word but not what all were when there their which will would "
        "tion ation ment ness able ible ing ings ed er ers est ly ous ive ize ise ity ence ance ent ant ern str thr con pro pre per sub inter over under"
    ).encode(),
    dict_type=zstandard.DICT_TYPE_RAWCONTENT,
)
_LETTERS, _DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]")
_PAIRS = {w[i : i + 2] for w in _LETTERS.findall(PRIMER.as_bytes().decode().lower()) for i in range(len(w) - 1)}
_COMPRESS = zstandard.ZstdCompressor(level=6, dict_data=PRIMER, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Marginal compressed bytes a character of the candidate where it stands."""
    size = lambda s: len(_COMPRESS.compress(s.encode()))
    return (size(before + candidate + after) - size(before + after)) / max(1, len(candidate))


def alphabet_size(candidate: str) -> int:
    """Characters a candidate draws from, by the kinds it has: hex of one case, or digits and each case; and its own symbols."""
    plain = "".join(c for c in candidate if c.isalnum())
    if set(plain) <= set("0123456789abcdef") or set(plain) <= set("0123456789ABCDEF"):
        known = 16
    else:
        known = 10 * bool(_DIGITS.search(plain)) + 26 * (plain != plain.upper()) + 26 * (plain != plain.lower())
    return known + len(set(candidate) - set(plain))


def made_of_words(candidate: str) -> bool:
    """Whether nearly all pairs of adjacent letters are the dictionary's; strings in hex have too few letters to tell."""
    if alphabet_size(candidate) - len({c for c in candidate if not c.isalnum()}) == 16:
        return False
    pairs = [w[i : i + 2] for w in _LETTERS.findall(candidate.lower()) for i in range(len(w) - 1)]
    return len(pairs) >= WORD_PAIRS and sum(p in _PAIRS for p in pairs) > WORDLIKE * len(pairs)


def is_random(candidate: str, cost: float) -> bool:
    """Whether a candidate of that novelty is random: no length passes or fails by the compressor's fixed costs alone."""
    return cost >= NOVELTY * math.log2(alphabet_size(candidate)) / 8 and not made_of_words(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end, kind of the fixed shapes, by start and then kind as listed. Cheap substring tests come first; they skip no match."""
    spans = []
    folded = text if text.islower() else text.lower()
    if any(w in folded for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def covered(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    """Whether spans, in the order of their starts, hold every character from start to end."""
    for a, b, _ in spans:
        if a > start or start >= end:
            break
        start = max(start, b)
    return start >= end


def scan(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans of a whole text: start, end (code points), kind, novelty; by start and then kind as listed."""
    if not text:
        return []
    spans = base_spans(text)
    found = [(a, b, kind, novelty(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])) for a, b, kind in spans]
    folded = text if text.islower() else text.lower()
    if any(w in folded for w in SENSITIVE):
        for m in CANDIDATE.finditer(text):
            a, b = m.span(1)
            value = m[1]
            if covered(a, b, spans) or not (re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value)):
                continue
            n = novelty(text[max(0, a - AROUND) : a], value, text[b : b + AROUND])
            if is_random(value, n):
                found.append((a, b, "novel", n))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each reported span, overlapping ones merged, replaced by the mask."""
    if not text:
        return text
    out, at = [], 0
    for a, b, *_ in scan(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its spans as array<struct<start, end, kind, novelty>>, whole texts, code points, end exclusive.

    Null and empty texts have no spans; null and repeated ids pass through; other columns are ignored; spans of
    different kinds may overlap (a tie in start keeps the kinds' listed order).
    """
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("start", "end", "kind", "novelty"), s, strict=True)) for s in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return _selected(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string, novelty: double>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_secrets with counts and digests in place of the array: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, max_novelty (null without spans)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            base = [[s for s in x if s[2] != "novel"] for x in found]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[2] == k for s in x) for x in found], pa.int64()) for k in KINDS[:3]]
            columns += [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in found])]
            columns += [pa.array([sum(s[2] == "novel" for s in x) for x in found], pa.int64()), pa.array([max((round(s[3], 6) for s in x), default=None) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "max_novelty"])

    return _selected(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, max_novelty double")


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with every reported span of the text column masked; null texts stay null."""
    prepare(docs.sparkSession)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t.as_py()) for t in batch.column(where)], pa.string())
            columns = batch.columns
            columns[where] = texts
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        settle()

    return docs.withColumn(text_col, docs[text_col].cast("string")).mapInArrow(run, docs.withColumn(text_col, docs[text_col].cast("string")).schema)
