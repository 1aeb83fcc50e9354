"""Results of the queries' operators against plain scans written from their definitions, and odd rows with defined results."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import near_dedup, quality, secret_scan, token_counts

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_spans(text):
    """The fixed shapes by a hand-written scan: no regular expression of the operator's."""
    text = text or ""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    found, at = [], 0
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    while at < len(text):
        best = next((n for n in names if lower.startswith(n, at)), None)
        end = None
        if best:
            k = at + len(best)
            k += k < len(text) and text[k] in "\"'"
            while k < len(text) and text[k] == " ":
                k += 1
            if k < len(text) and text[k] in ":=":
                k += 1
                while k < len(text) and text[k] == " ":
                    k += 1
                k += k < len(text) and text[k] in "\"'"
                stop = k
                while stop < len(text) and text[stop] in value:
                    stop += 1
                if stop > k:
                    end = stop
                    if stop - k >= 12:
                        found.append((at, end, "assign"))
        at = end or at + 1
    for kind, first, rest, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), ("hex", "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            stop = at + len(first) if text.startswith(first, at) else at
            if text.startswith(first, at):
                while stop < len(text) and text[stop] in rest:
                    stop += 1
            if stop > at + len(first):
                if stop - at >= least:
                    found.append((at, stop, kind))
                at = stop
            else:
                at += 1
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[0], order.index(s[2])))


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(8)
    bits = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "AKIA", '"', "'", " ", ":", "=", "abcdefghijkl", "0123456789abcdef", "ABCDEF0123456789", "é", "/", "x", "\n", "ſ", "K", "tokens"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        assert secret_scan.base_spans(t) == plain_spans(t), t
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.secret_digests(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want, row = plain_spans(r["text"]), got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[2] == k for s in want) for k in ("assign", "access", "hex")]


def test_prose_has_no_novel_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = secret_scan.secret_digests(docs).agg(F.sum("n_novel"), F.count(F.lit(1))).first()
    assert rows[0] <= 0.02 * rows[1]


def test_secrets_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "AKIAABCDEFGHIJ1234", "x"), (3, "z " * 60000 + "deadbeefdeadbeef", "y"), (3, "z", "y")], "doc_id long, text string, spans string")
    rows = {(r["doc_id"], r["spans"]) for r in secret_scan.secret_digests(odd).collect()}
    assert rows == {(1, ""), (2, ""), (None, "access:0:18"), (3, "hex:120000:120016"), (3, "")}
    assert {(r["doc_id"], r["text"]) for r in secret_scan.redact_documents(odd).filter("doc_id is null or doc_id < 3").collect()} == {(1, None), (2, ""), (None, "[SECRET]")}


def test_token_counts_bytes_limits_and_json_tokenizers(spark, tmp_path):
    rows = [(1, "é 日本", "a"), (2, None, "b"), (3, "word " * 5000, "c"), (None, "a <|endoftext|> b", "d"), (3, "another text", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, PIECES, str(tmp_path / "a")).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in rows)
    from pathlib import Path

    path = next((str(p) for p in Path(public_tokenizers.__file__).parent.rglob("*.json") if "model" in p.read_text()[:4000] or "vocab" in p.read_text()[:400000]), None)
    if path is None:
        pytest.skip("no tokenizer file of this kind")
    try:
        tokenizer = Tokenizer.from_file(path)
    except Exception:
        pytest.skip("not a tokenizer file")
    tokenizer.no_truncation()
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(docs, path, str(tmp_path / "a")).collect()) == want


def test_cached_counts_are_used(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a text"), (2, "b text")], "doc_id long, text string")
    version = token_counts.tokenizer_version(PIECES)
    known = spark.createDataFrame([(version, bytearray(hashlib.sha256(b"a text").digest()), 77)], token_counts.CACHE)
    known.write.partitionBy("version").parquet(str(tmp_path / "c"))
    assert {r["doc_id"]: r["n_tokens"] == 77 for r in token_counts.count_tokens(docs, PIECES, str(tmp_path / "c")).collect()} == {1: True, 2: False}


def test_quality_pools_and_scores_as_plain_loops_do_and_is_calibrated(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = quality.train_quality(docs, labels, learn)
    w1, b1, w2, b2 = model.layers

    def plain(text):
        ids = [quality._bucket(w) for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")]
        x = np.array([model.vectors[i] for i in ids], float) if ids else np.zeros((0, quality.DIM))
        pooled = np.concatenate([x.mean(0), np.sqrt(np.maximum((x * x).mean(0) - x.mean(0) ** 2, 0)), [np.log1p(len(ids))]]) if ids else np.zeros(2 * quality.DIM + 1)
        z = (np.tanh(((pooled - model.centre) / model.scale) @ w1 + b1) @ w2 + b2) / model.temperature
        return 1 / (1 + np.exp(-z))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scored = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    for i in sorted(texts)[:60]:
        assert abs(scored[i]["score"] - plain(texts[i])) < 1e-3 and scored[i]["predicted"] == (scored[i]["score"] >= 0.3)
    held = [(scored[r["doc_id"]]["score"], r["quality"]) for r in labels.filter(~learn).collect() if r["doc_id"] in scored and r["quality"] is not None]
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    bins = np.clip((s * 5).astype(int), 0, 4)
    gap = sum(abs(s[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert gap < 0.1
    one = quality.train_quality(docs, labels.filter("quality = 1"), learn)  # one class: everything is that class
    assert quality.score_quality(docs, one).filter("score < 0.5").isEmpty()


def plain_sets(text, n):
    """Distinct word n-grams as tuples, from the definition."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", words) if w]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def plain_components(rows, percent, n):
    sets = [(i, plain_sets(t, n)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and (i == j or 100 * len(a & b) >= percent * len(a | b)):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in label}


def test_large_partly_linked_group_equals_brute_force(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(2000):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4])):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link_components(docs, 85, 3).collect()}
    want = plain_components(rows, 85, 3)
    assert got == want and 10 < len(set(want.values())) < 2000


def test_large_groups_meet_in_few_tile_pairs(spark, monkeypatch):
    rng, words, sent = random.Random(6), [f"w{i}" for i in range(2000)], []
    search = near_dedup._open_tiles

    def counted(*args):
        out = search(*args)
        sent.append(out[0].count())
        return out

    monkeypatch.setattr(near_dedup, "_open_tiles", counted)
    monkeypatch.setattr(near_dedup, "TILE_BYTES", 64 << 10)
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(1200):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link_components(docs, 85, 3).collect()}
    assert got == plain_components(rows, 85, 3)
    assert 0 < sent[0] <= 2 * len(rows)


def test_similar_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(4)
    rarity = rng.integers(0, 50, near_dedup.RARITY).astype(np.uint32)
    pool, similar = rng.integers(0, 2**63, 60, dtype=np.uint64), 0
    for _ in range(3000):
        percent = int(rng.choice([50, 80, 85, 100]))
        x = np.unique(rng.choice(pool, rng.integers(1, 40), replace=False))
        y = np.unique(np.concatenate([x[: len(x) - rng.integers(0, 4)], rng.choice(pool, rng.integers(0, 4))]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
            similar += 1
            p, q = (dict(zip(*(c.tolist() for c in near_dedup.prefix(s, rarity, percent)), strict=True)) for s in (x, y))
            assert any(p[t] >= len(y) and q[t] >= len(x) for t in p.keys() & q.keys())
    assert similar > 500


def test_near_duplicates_of_repeated_ids_nulls_and_clashing_columns(spark):
    rows = [(4, "a b c d e f", "p"), (4, "x y z u v w", "p"), (2, "x y z u v w", "q"), (9, "a b c d e f", "q"), (4, "", "r"), (7, None, "r"), (None, "x y z u v w", "s"), (11, "  solo", "s"), (12, "Solo TWO", "s"), (13, "solo two", "s"), (14, "w " * 40000, "t"), (15, "w " * 40000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    out = near_dedup.link_components(docs, 85, 3).collect()
    assert len(out) == len(rows)
    for r in out:
        want = {4: 2, 2: 2, 9: 2, 7: 7, None: None, 11: 11, 12: 12, 13: 12, 14: 14, 15: 14}[r["doc_id"]]
        assert r["component_id"] == want and r["kept"] == (r["doc_id"] is None or r["doc_id"] == want)
    kept = near_dedup.keep_one_each(docs, 85, 3)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 7, 11, 12, 14]


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id is here", "en", "src0", 28, "k"), (900001, None, None, None, None, "k"), (900002, "", "en", "src1", 0, "k"), (900003, "12 34 !!", None, "src1", 8, "k"), (900004, "the and of " * 30000, "en", "src0", 330000, "k")], "doc_id long, text string, lang string, source string, n_chars long, prob string")
    every = docs.withColumn("prob", F.lit("k")).unionByName(odd).unionByName(docs.limit(3).withColumn("prob", F.lit("again")))
    every.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    rows = out.collect()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and rows
    assert not {900001, 900002, 900003} & {r["doc_id"] for r in rows}  # no letters: language ID rejects them
    none = every.limit(0)
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
