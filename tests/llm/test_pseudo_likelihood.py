"""Pseudo-likelihood: brute-force sums over the whole vocabulary, partitioning, word order, twins, odd rows."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from graphloom.llm import pseudo_likelihood as P

WORDS = [f"w{i}" for i in range(6000)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    often = WORDS[:300]
    out = [(i, " ".join(rng.choice(often) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(rng.randint(20, 120)))) for i in range(400)]
    return [*out, (400, "only here stand words nobody else has"), (401, None), (402, ""), (403, " ".join(WORDS)), (3, "a repeated id"), (None, "no id here"), (2**60 + 1, "a large id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def model(docs):
    return P.train(docs)


def word(w):
    return int(P.word_hashes(w)[0])


def plain(model, counts, context_of, text):
    """Per token: the probability of every word that exists and of one unseen word a class, by plain loops over the definition."""
    words = text.lower().split()
    own = Counter(words)
    place = {w: int(model.words.rank(P.word_hashes(w))[0]) for w in counts}
    inputs, out, bias, word_out, word_bias = (x.astype(float) for x in P.parts(model.weights))
    ids = [place[w] if place[w] >= 0 else P.TOP + (word(w) >> 32) % P.RARE_INPUTS for w in words]
    result = []
    for k in range(len(words)):
        around = [ids[k + d] if 0 <= k + d < len(ids) else P.BORDER for d in (-2, -1, 1, 2)]
        h = np.tanh(sum(inputs[j][a] for j, a in enumerate(around)))
        z = h @ out + bias + model.words.class_mask
        first = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        size = {c: sum(n - own[w] for w, n in counts.items() if place[w] < 0 and context_of[w] == c) + model.alpha * (1 + sum(place[w] < 0 and context_of[w] == c for w in counts)) for c in range(P.CONTEXTS)}
        probs, second = {f"unseen {c}": first[P.CLUSTERS + c] * model.alpha / size[c] for c in range(P.CONTEXTS)}, {}
        for w, n in counts.items():
            if place[w] >= 0:
                c = place[w] // P.WIDTH
                if c not in second:
                    y = h @ word_out[c] + word_bias[c] + model.words.word_mask[c]
                    second[c] = np.exp(y - y.max()) / np.exp(y - y.max()).sum()
                probs[w] = first[c] * second[c][place[w] % P.WIDTH]
            else:
                probs[w] = first[P.CLUSTERS + context_of[w]] * (n - own[w] + model.alpha) / size[context_of[w]]
        result.append(probs)
    return words, result


def test_scores_are_brute_force_sums_and_conditionals_sum_to_one(docs, model, rows):
    texts = [t or "" for _, t in rows]
    counts = Counter(w for t in texts for w in t.lower().split())
    ranked = sorted(counts, key=lambda w: (-counts[w], word(w)))
    assert {w for w in counts if model.words.rank(P.word_hashes(w))[0] >= 0} == set(ranked[: P.TOP])
    before = {}
    for t in texts:
        ws = t.lower().split()
        for k, w in enumerate(ws):
            cell = (word(w) >> 12) % P.CELLS
            before.setdefault(cell, Counter())[(word(ws[k - 1]) >> 6) % P.CONTEXTS if k else 0] += 1
    context_of = {w: min(before[(word(w) >> 12) % P.CELLS].items(), key=lambda cn: (-cn[1], cn[0]))[0] for w in counts}
    assert len(counts) - P.TOP > 1000
    got = {r["doc_id"]: r for r in P.score(docs, model).collect() if r["doc_id"] in (5, 400)}
    for i in (5, 400):
        words, probs = plain(model, counts, context_of, dict(rows)[i])
        assert all(abs(sum(p.values()) - 1) < 1e-4 for p in probs)
        want = sum(np.log(p[w]) for w, p in zip(words, probs, strict=True))
        assert got[i]["n_tokens"] == len(words) and abs(got[i]["pll"] - want) < 1e-4 * abs(want)
        assert got[i]["n_novel"] == sum(counts[w] == words.count(w) for w in words if w not in set(ranked[: P.TOP]))


def test_scores_do_not_depend_on_partitioning(spark, rows, docs, model):
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    a, b = ({(r["doc_id"], r["n_tokens"]): r["pll"] for r in P.score(d, m).collect()} for d, m in ((docs, model), (one, P.train(one))))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-4 * max(1, abs(a[k])) for k in a)


def test_odd_rows(spark, docs, model, rows):
    out = P.score(docs, model).collect()
    assert len(out) == len(rows)
    found = {r["doc_id"]: r for r in out}
    assert all(found[i]["n_tokens"] == 0 and found[i]["pll"] == 0.0 and found[i]["pll_per_token"] is None for i in (401, 402))
    assert found[403]["n_tokens"] == 6000 and found[None]["n_tokens"] == found[2**60 + 1]["n_tokens"] == 3 and found[400]["n_novel"] > 0
    nothing = spark.createDataFrame([], "doc_id long, text string, pll string")
    assert P.score(nothing, P.train(nothing)).count() == 0


def test_seen_order_is_likelier_and_a_twin_is_no_novelty(spark):
    rng, pattern = random.Random(4), ["red", "dog", "ran", "far", "home"]
    rows = [(i, " ".join(pattern * rng.randint(40, 80))) for i in range(120)]
    rows += [(500, " ".join(pattern * 60)), (501, " ".join(rng.sample(pattern * 60, 300)))]
    rows += [(600 + i, f"red dog quite{i % 3} new{i % 3}") for i in range(4)]  # 600 and 603 are twins
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.score(docs, P.train(docs)).collect()}
    assert got[500]["pll_per_token"] > got[501]["pll_per_token"] + 0.3
    assert got[600]["pll"] == pytest.approx(got[603]["pll"])


def test_every_token_trains_the_network(model, rows, monkeypatch):
    """Each token, with its neighbours, is learnt from once, in full blocks but the last."""
    texts, found, sizes = pd.DataFrame([(i, t) for i, t in rows if t], columns=["doc_id", "text"]), Counter(), []

    def learn(flat, memory, words, around, classes, place):
        sizes.append(len(classes))
        found.update(zip(map(tuple, around.tolist()), classes.tolist(), place.tolist(), strict=True))

    monkeypatch.setattr(P, "learn", learn)
    out = P._train_part(SimpleNamespace(value=model))(texts)
    want = Counter()
    for t in texts["text"]:
        _, place, classes, inputs = model.read(t)
        want.update(zip(map(tuple, P.windows(inputs).tolist()), classes.tolist(), place.tolist(), strict=True))
    assert found == want and set(out["n"]) == {sum(len(t.split()) for t in texts["text"])}
    assert len(sizes) > 2 and set(sizes[:-1]) == {P.BLOCK} and sizes[-1] <= P.BLOCK


@pytest.mark.parametrize("scale", [1, 60])  # with large weights the logits' maxima are taken off
def test_a_step_and_the_log_probabilities_are_plain_sums_in_little_space(monkeypatch, scale):
    """Against plain double precision, with missing outputs and a cluster of half of the tokens; logits are made 256 KB at a time."""
    rng, n, sizes, logits = np.random.default_rng(3), 5000, [], P._logits

    def seen(*args):
        z = logits(*args)
        sizes.append(z.nbytes)
        return z

    monkeypatch.setattr(P, "_logits", seen)
    class_mask, word_mask = np.zeros(P.CLASSES, np.float32), np.zeros((P.CLUSTERS, P.WIDTH), np.float32)
    class_mask[P.CLUSTERS - 1], word_mask[:, 40:] = -np.inf, -np.inf
    words = P.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32), class_mask, word_mask)
    classes = rng.permutation(np.append(np.full(n // 2, 2), rng.choice(np.delete(np.arange(P.CLASSES), P.CLUSTERS - 1), n - n // 2))).astype(np.int32)
    place = np.where(classes < P.CLUSTERS, classes * P.WIDTH + rng.integers(0, 40, n), -1).astype(np.int32)
    around = np.minimum(rng.zipf(1.3, (n, 2 * P.SIDE)) - 1, P.BORDER).astype(np.int32)
    flat = P.start()
    P.parts(flat)[1][:] *= scale
    P.parts(flat)[3][:] *= scale
    want, g = flat.astype(float), np.zeros(len(flat))
    (inputs, out, bias, word_out, word_bias), (g_inputs, g_out, g_bias, g_word, g_wbias) = P.parts(want), P.parts(g)
    h = np.tanh(sum(inputs[k][around[:, k]] for k in range(2 * P.SIDE)))
    back, scores = np.zeros_like(h), np.zeros(n)

    def softmax(rows, weights, biases, names, into):
        z = h[rows] @ weights + biases
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        scores[rows] += np.log(p[np.arange(len(p)), names])
        p[np.arange(len(p)), names] -= 1
        back[rows] += p @ weights.T
        into[0][:], into[1][:] = h[rows].T @ p, p.sum(0)

    softmax(np.arange(n), out, bias + class_mask, classes, (g_out, g_bias))
    for c in range(P.CLUSTERS):
        rows = np.nonzero(classes == c)[0]
        softmax(rows, word_out[c], word_bias[c] + word_mask[c], place[rows] % P.WIDTH, (g_word[c], g_wbias[c]))
    for k in range(2 * P.SIDE):
        np.add.at(g_inputs[k], around[:, k], back * (1 - h * h))
    g /= n
    assert P.log_probabilities(flat, words, around, classes, place) == pytest.approx(scores, abs=1e-4 * scale)
    memory = np.full_like(flat, 1e-6)
    P.learn(flat, memory, words, around, classes, place)
    assert np.abs(flat - (want - P.RATE * g / (np.sqrt(1e-6 + g * g) + 1e-6))).max() < 1e-5 * scale
    assert np.allclose(memory, 1e-6 + g * g, rtol=1e-4, atol=1e-6)
    assert max(sizes) <= 1 << 18


def test_hashes_are_plain_sums():
    """Of words that are long, in texts that are long, and between all kinds of white space."""
    powers = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(1024)]

    def plain(word):
        h = sum(int(P._BYTES[b]) * powers[j % 1024] for j, b in enumerate(word)) % 2**64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        return (h ^ h >> 32) & ~63

    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcXYZ0é") for _ in range(rng.randint(1, 9))) for _ in range(30000))
    for text in ("", " \t\n", "Two words", "\x0b a\fb\rc\x1cd\x00 ", "x" * 1023 + " y", "x" * 1024 + " y", "z " + "xy" * 1500 + " y", "a" + " " * 3000 + "b", long[:100000], long):
        assert P.word_hashes(text).tolist() == [plain(w) for w in text.lower().encode().split()]
