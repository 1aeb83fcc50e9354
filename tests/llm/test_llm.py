"""The corpus operators against libraries, brute force, round trips and held-out rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import audio_prints, hamming_search, language_id, near_dedup, piece_codec, quality, registry, secret_scan, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows and columns whose names clash with results."""
    rows = [(1, "", "en", "a", 0, "x", "y"), (2, None, None, None, None, "x", "y"), (None, "the cat sat on the mat", "en", "a", 22, "x", "y"), (3, "word " * 30000, "en", "a", 150000, "x", "y"), (4, "12 34", "en", None, 5, "x", "y"), (4, "12 34", "en", None, 5, "x", "y"), (5, "une phrase très courte", "fr", "b", 22, "x", "y")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def test_codec_equals_the_library():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.codec(PIECES)
    random.seed(5)
    cases = ["", " ", "  a  b ", "hello\nworld", "▁x", "a\x00b", "<0x0A> <s> </s>", "é́ ﬁ", "\t x", "a" * 3000, " " * 40, "😀日本語テスト   x"]
    cases += ["".join(random.choice("aetohin  ▁\n.,é日ing thes") for _ in range(random.randint(1, 60))) for _ in range(500)]
    pieces = list(codec.id)
    cases += ["".join(random.choice(pieces) for _ in range(6)) for _ in range(500)]
    for text in cases:
        ids = sp.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == sp.decode(ids)
    for _ in range(300):
        ids = [random.randrange(600) for _ in range(random.randint(0, 8))]
        assert codec.decode(ids) == sp.decode(ids)


def test_codec_encodes_unseen_units_together():
    """Documents of invented words, odd ones among them, equal the library's, and few units are walked by themselves."""
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(11)
    parts = "the tion ing and é ou euxe ño ré trou ст ра но , . ; - 's 20 7 日本 anti sh th er e a n s".split()
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(300)]
    texts += [None, "", " ", "\n", "▁x  y", "😀a b\tc\x00d", "a" * 3000, "e" * 47, "e" * 48 + " " + "e" * 49, "\r\n x\n\n", "ab cd" * 20]
    alone, walk = [], codec._backtrack
    codec._backtrack = lambda run: alone.append(run) or walk(run)
    distinct = {u for t in texts for u in piece_codec.UNITS.findall(" " + (t or ""))}
    for text, found in zip(texts, codec.encode_many(texts), strict=True):
        ids = sp.encode(text or "")
        assert " ".join(found) == " ".join(map(str, ids))
        assert codec.decode(ids) == sp.decode(ids)
    assert len(distinct) > 10_000 and len(alone) < len(distinct) / 10


def test_codec_forgets_units_within_its_bound(monkeypatch):
    monkeypatch.setattr(piece_codec, "UNITS_HELD", 500)
    monkeypatch.setattr(piece_codec, "TOGETHER", 3000)
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(12)
    texts = [" ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(200)]
    for text, found in zip(texts, codec.encode_many(texts), strict=True):
        assert " ".join(found) == " ".join(map(str, sp.encode(text)))
    assert len(codec.units) <= 500


def test_encoding_of_documents(spark, odd, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = piece_codec.encode_digests(odd, PIECES).collect()
    assert len(out) == odd.count() and piece_codec.encode_digests(nothing, PIECES).count() == 0
    for r in out:
        if r["doc_id"] == 5:
            ids = sp.encode("une phrase très courte", add_eos=True)
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        if r["doc_id"] in (1, 2):
            assert r["n_tokens"] == 1 and r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    again = piece_codec.decode_documents(piece_codec.encode_documents(odd, PIECES), PIECES)
    assert {r["text"] for r in again.filter("doc_id = 5").collect()} == {"une phrase très courte"}


def test_token_counts_use_and_extend_the_cache(spark, odd, nothing, tmp_path):
    sp, path = sentencepiece.SentencePieceProcessor(model_file=PIECES), str(tmp_path / "cache")
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(sp.encode(r["text"] or ""))) for r in odd.collect())
    for _ in range(2):
        got = token_counts.count_tokens(odd, PIECES, path).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == want
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("digest").distinct().count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.count_tokens(nothing, PIECES, path).count() == 0


def test_secret_spans():
    text = 'x password = "abcdefghijkl" AKIAABCDEFGHIJ1234 deadbeefdeadbeef0 token=short'
    kinds = [(k, text[a:b]) for a, b, k in secret_scan.base_spans(text)]
    assert kinds == [("assign", 'password = "abcdefghijkl'), ("access", "AKIAABCDEFGHIJ1234"), ("hex", "deadbeefdeadbeef0")]
    noise = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    assert [s[2] for s in secret_scan.scan(f"é authorization: bearer {noise} end")] == ["novel"]
    assert secret_scan.scan("the bearer of implementation_documentation_1 configuration") == []
    assert secret_scan.scan(None) == secret_scan.scan("") == []
    assert secret_scan.redact(text) == "x [SECRET]\" [SECRET] [SECRET] token=short"


def test_random_keys_of_every_alphabet_and_length_are_random():
    rng, letters = random.Random(17), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for alphabet in ("0123456789ABCDEF", "0123456789" + letters.lower(), letters + "234567", letters + letters.lower() + "0123456789+/"):
        for size in (16, 24, 32, 64, 128, 256, 512, 1000, 2000):
            keys = ["".join(rng.choices(alphabet, k=size)) for _ in range(100 if size < 500 else 20)]
            passed = sum(secret_scan.is_random(k, secret_scan.novelty("then authorization: bearer ", k, " is sent")) for k in keys)
            assert passed >= 0.97 * len(keys), (alphabet, size)
    for name in ("getUserAccountBalance2", "process.env.API_TOKEN_V2", "README_installation_guide_2024", "validateTokenExpiry2Hours", "my-super-long-password-123", "zzzzzzzzzzzzzzzzzzzz1"):
        assert secret_scan.scan(f"the bearer {name} of it") == [], name


def test_long_and_partly_fixed_candidates_are_masked_whole():
    rng = random.Random(23)
    draw = lambda n: "".join(rng.choices("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789", k=n))
    for size in (600, 2000, 20000):
        assert secret_scan.redact(f"authorization: bearer {draw(size)} end") == "authorization: bearer [SECRET] end"
    assert secret_scan.redact(f"password=Abcdefghijkl!{draw(30)} end") == "[SECRET] end"
    key = f"{draw(20)}deadbeefdeadbeef{draw(20)}"
    assert secret_scan.redact(f"authorization: bearer {key} end") == "authorization: bearer [SECRET] end"
    assert [s[:3] for s in secret_scan.scan(f"bearer {key} end")] == [(7, 63, "novel"), (27, 43, "hex")]
    value = draw(40)  # held whole by a fixed shape: reported once
    assert [s[2] for s in secret_scan.scan(f"password={value} end")] == ["assign"]
    jwt = f"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.{draw(700)}.{draw(43)}"
    assert secret_scan.redact(f"authorization: bearer {jwt}\nnext") == "authorization: bearer [SECRET]\nnext"


def test_secret_tables(odd, nothing):
    assert secret_scan.secret_digests(odd).count() == odd.count() and secret_scan.find_secrets(nothing).count() == 0
    assert secret_scan.redact_documents(odd).columns == odd.columns and secret_scan.redact_documents(odd).count() == odd.count()


def test_language_accuracy_and_rejection(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train_on(docs)
    out = registry.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert np.mean([r["rejected"] for r in out]) < 0.02
    found = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (1, 2, 4))
    assert language_id.identify(nothing, model).count() == 0
    assert language_id.keep_identified(docs, model).count() > 0.98 * docs.count()
    assert language_id.train_on(nothing).predict("abc")[0] == "und"


STRANGE = ["Det er en meget smuk dag i dag og vi skal ud at gå en tur i skoven med vores venner", "Oggi è una bella giornata e vogliamo andare nel bosco con i nostri amici per una passeggiata", "Dzisiaj jest piękny dzień i chcemy iść na spacer do lasu z naszymi przyjaciółmi"]


@pytest.mark.parametrize("languages", [("en", "fr", "de", "es"), ("en", "de")])
def test_rejection_of_gibberish_unseen_languages_and_short_texts(spark, languages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(*languages))
    model, rng = language_id.train_on(docs), random.Random(3)
    gibberish = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (120, 400) for _ in range(50)]
    assert np.mean([model.predict(t)[2] for t in gibberish]) == 1.0
    assert all(model.predict(t)[2] for t in STRANGE)
    assert model.predict("   a ")[1] < 0.9
    held = [(r["text"], r["lang"]) for r in docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()]
    out = [model.predict(t) for t, _ in held]
    assert np.mean([o[2] for o in out]) < 0.02 and np.mean([o[0] == lang for o, (_, lang) in zip(out, held, strict=True)]) > 0.97
    parts = [(t[100:116], lang) for t, lang in held if len(t) > 200]
    out = [model.predict(t) for t, _ in parts]
    kept = [(o[0] == lang, o[1]) for o, (_, lang) in zip(out, parts, strict=True) if not o[2]]
    assert len(kept) > 0.5 * len(parts) and np.mean([k[0] for k in kept]) > 0.85
    assert abs(np.mean([k[1] for k in kept]) - np.mean([k[0] for k in kept])) < 0.08  # calibrated on short texts


def test_held_out_rows_and_their_language_do_not_change_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    a, b = language_id.train_on(docs), language_id.train_on(other)
    assert a.languages == b.languages and np.array_equal(a.table, b.table) and a.least_sure == b.least_sure


def test_quality_separates_held_out_rows(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    out = registry.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    model = quality.train_quality(odd, odd.select("doc_id", F.lit(1).alias("quality")))
    assert quality.score_quality(odd, model).filter("score between 0 and 1").count() == odd.count()
    empty = quality.train_quality(nothing, nothing.select("doc_id", F.lit(1).alias("quality")))
    assert quality.score_quality(nothing, empty).count() == 0


def test_word_vectors_count_all_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))) for i in range(20)]
    rows += [(100 + i, "unlabelled words " * 5 + f"only{i} here") for i in range(30)] + [(200, None), (None, "gamma rays")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = docs.filter("doc_id < 20").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train_quality(docs, labels, sample=10)
    want = quality.word_vectors(*quality.context_sums(t for _, t in rows))
    assert np.allclose(model.vectors, want, rtol=1e-5, atol=1e-7)
    index, plain = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.DIM))
    for ids in (quality.word_buckets(t).tolist() for _, t in rows):
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                plain[a] += index[ids[j]] * (i != j)
    assert np.array_equal(plain, quality.context_sums(t for _, t in rows)[0])


def brute_components(rows, percent, n):
    sets = [(i, set(near_dedup.shingles(t, n).tolist())) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def test_near_duplicates_equal_brute_force(spark, nothing):
    rng, words = random.Random(9), [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(150)]
    for i in range(120):
        if i < 60:  # a chain of copies around the limit
            text = list(base)
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 40]))]
        rows.append((i, " ".join(text)))
    rows += [(200, rows[3][1]), (201, None), (202, "Only two"), (203, "only TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dedup.link_components(docs, 85, 3).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(rows, 85, 3)
    assert got[201]["n_shingles"] == 0 and got[201]["kept"] and got[203]["component_id"] == 202 and not got[203]["kept"]
    assert near_dedup.link_components(nothing).count() == 0
    kept = near_dedup.keep_one_each(docs, 80, 5)
    want = brute_components(rows, 80, 5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_near_duplicates_with_odd_rows(odd):
    out = near_dedup.link_components(odd).collect()
    assert len(out) == odd.count()
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)


def test_hamming_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(-(2**63), 2**63 - 1, 300)
    codes[100:180] = codes[100]
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(None, 5), (999, None), (7, int(codes[7]))]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming_search.search(df, df.filter("id % 20 = 0"), 10, entry_block=64, query_block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    for q in range(0, 300, 20):
        best = sorted((bin((int(codes[q]) ^ int(c)) & (2**64 - 1)).count("1"), i) for i, c in enumerate(codes))[:10]
        assert sorted(got[q]) == [(n + 1, i, d) for n, (d, i) in enumerate(best)]
    assert hamming_search.search(df.limit(0), df).count() == hamming_search.search(df, df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, 5, "x"), (2, 5, "y"), (3, -1, "z")], "id long, code long, distance string")
    assert sorted(tuple(r) for r in hamming_search.search(few, few.filter("id = 3")).collect()) == [(3, 1, 3, 0), (3, 2, 1, 62), (3, 3, 2, 62)]


def plain_align(query, other):
    """Offset, votes and bit error rate of the best offset, by counting all equal pairs of successive integers."""
    votes = {}
    for i, a in enumerate(zip(query.tolist(), query.tolist()[1:], strict=False)):
        for j, b in enumerate(zip(other.tolist(), other.tolist()[1:], strict=False)):
            if a == b:
                votes[j - i] = votes.get(j - i, 0) + 1
    if not votes:
        return None

    def errors(o):
        pairs = [(query[i], other[i + o]) for i in range(len(query)) if 0 <= i + o < len(other)]
        return sum(bin(int(a) ^ int(b)).count("1") for a, b in pairs) / (32 * len(pairs))

    most = max(votes.values())
    best = min((errors(o), abs(o), o) for o, v in votes.items() if v == most)
    return best[2], most, best[0]


def test_runs_vote_like_pairs_and_an_hour_fits(spark):
    rng = np.random.default_rng(5)
    for trial in range(12):
        q, e = (np.repeat(rng.integers(0, 3, 14), rng.integers(1, 6, 14)) for _ in range(2))
        df = lambda name, codes: spark.createDataFrame([(1, codes.tolist())], f"{name} long, codes array<long>")  # noqa: B023, E731
        got = {r["offset"]: r["votes"] for r in audio_prints._offsets(df("class_id", e), df("clip_class", q)).collect()}
        votes = {}
        for i, a in enumerate(zip(q, q[1:], strict=False)):
            for j, b in enumerate(zip(e, e[1:], strict=False)):
                if a == b:
                    votes[j - i] = votes.get(j - i, 0) + 1
        best = {o for o, v in votes.items() if v == max(votes.values())}
        ends = {o for o in best if not (o - 1 in best and o + 1 in best)}
        assert set(got) >= ends and set(got) <= best and set(got.values()) == {max(votes.values())}, trial
    hour = (np.sin(np.arange(3600 * audio_prints.RATE) * 0.4 * (1 + (np.arange(3600 * audio_prints.RATE) // 40000) % 7)) * 20000).astype("<i2")
    media = spark.createDataFrame([(1, hour.tobytes(), "x"), (2, hour[40 * audio_prints.HOP :].tobytes(), "y")], "media_id long, audio binary, codes string")
    prints = audio_prints.fingerprints(media)
    out = [r for r in audio_prints.match_classes(prints, prints.filter("media_id = 2")).collect() if r["kind"] == "match"]
    assert {(r["class_id"], r["offset"]) for r in out} == {(1, 40), (2, 0)}


def test_audio_matches_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.15, 64).astype(float).tolist()) for i in range(40)]
    vectors[30] = (30, vectors[3][1])
    df = spark.createDataFrame([*vectors, (50, None), (51, [0.1])], "vec_id long, embedding array<float>")
    prints = audio_prints.fingerprints(audio_prints.render_tones(df))
    clips = audio_prints.fingerprints(audio_prints.render_tones(df.filter("vec_id < 6"), skip=10 * audio_prints.HOP, noise=0.01))
    known = {r["media_id"]: np.array(r["codes"], np.uint32) for r in prints.collect()}
    asked = {r["media_id"]: np.array(r["codes"], np.uint32) for r in clips.collect()}
    got = {r["media_id"]: r for r in audio_prints.match_recordings(prints, clips).collect()}
    assert len(got) == 42 and got[30]["class_id"] == 3 and got[50]["n_codes"] == 0 and got[50]["matches"] is None
    for q, codes in asked.items():
        want = []
        for i, other in known.items():
            a = plain_align(codes, other) if len(other) else None
            if a and a[1] >= audio_prints.MIN_VOTES and a[2] <= audio_prints.MAX_ERROR:
                want.append((a[2], i, a[0]))
        assert [(m["media_id"], m["offset"]) for m in got[q]["matches"]] == [(i, o) for _, i, o in sorted(want)]
        assert got[q]["matches"][0]["media_id"] == q and got[q]["matches"][0]["offset"] == 10


def test_audio_matches_have_no_cap(spark):
    rng = np.random.default_rng(8)
    vectors = [rng.normal(0, 0.15, 64).tolist() for _ in range(12)]
    rows = [(i, vectors[0]) for i in range(9)] + [(20 + i, v) for i, v in enumerate(vectors[1:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    prints = audio_prints.fingerprints(audio_prints.render_tones(df))
    near = audio_prints.fingerprints(audio_prints.render_tones(df.filter("vec_id < 9"), skip=audio_prints.HOP, noise=0.01))
    prints = prints.unionByName(near.withColumn("media_id", F.col("media_id") + 100))  # nine aligned copies, few of them equal
    clips = audio_prints.fingerprints(audio_prints.render_tones(df.filter("vec_id in (0, 1, 25)"), skip=10 * audio_prints.HOP, noise=0.01))
    known = {r["media_id"]: np.array(r["codes"], np.uint32) for r in prints.collect()}
    asked = {r["media_id"]: np.array(r["codes"], np.uint32) for r in clips.collect()}
    want = {}
    for q, codes in asked.items():
        aligned = {i: plain_align(codes, other) for i, other in known.items()}
        want[q] = {(i, a[0], a[1]) for i, a in aligned.items() if a and a[1] >= audio_prints.MIN_VOTES and a[2] <= audio_prints.MAX_ERROR}
    assert len(want[0]) >= 18
    out = audio_prints.match_classes(prints, clips).collect()
    member, clip = {}, {r["media_id"]: r["clip_class"] for r in out if r["kind"] == "clip"}
    for r in out:
        if r["kind"] == "recording":
            member.setdefault(r["class_id"], []).append(r["media_id"])
    assert sorted(i for ids in member.values() for i in ids) == sorted(known) and set(range(9)) <= set(member[0])
    pairs = [r for r in out if r["kind"] == "match"]
    assert len(pairs) == len({(r["clip_class"], r["class_id"]) for r in pairs})
    for q in asked:
        assert {(i, r["offset"], r["votes"]) for r in pairs if r["clip_class"] == clip[q] for i in member[r["class_id"]]} == want[q]
    full = {r["media_id"]: r["matches"] for r in audio_prints.match_recordings(prints, clips).collect()}
    assert all({(m["media_id"], m["offset"], m["votes"]) for m in full[q]} == want[q] for q in asked)


def test_pipeline_stages_keep_columns_and_lose_nothing_clean(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len(seen[1]) > 0.98 * len(seen[0])
    assert seen[2] == {i for i, c in brute_components([r for r in rows if r[0] in seen[1]], 80, 5).items() if i == c}
    assert seen[3] == seen[2] and len(seen[4]) > 0.3 * len(seen[3])
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == seen[4]
