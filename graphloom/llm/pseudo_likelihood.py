"""Document scores by masked pseudo-likelihood of a bidirectional window network over words.

Every word of a text is predicted from SIDE words on either side of it, itself masked; the sum of the words'
conditional log-probabilities is the document's score. The softmax over the vocabulary is hierarchical:

- The TOP most frequent words are clustered by the words before them into CLUSTERS clusters of WIDTH words. The network
  gives the probability of a cluster, and then that of each word of the cluster.
- A rarer word belongs to one of CONTEXTS classes by what stands before it most often (words of one of CELLS hash cells
  share their class). The network gives the probability of the class; within it a word has its share of the exact
  corpus counts, smoothed by `alpha`, with one share for words never seen. A document's own words are taken out of the
  counts when it is scored, so words that no other document has cost it more than words that another one has too.

Exact counts of all distinct words are gathered by hash bucket, once to find the frequent words and the classes, once
with the documents that have the words; both grow with the corpus, and so does the number of buckets, so that no
task's share does. Hashes and counts move in packed arrays. The driver gets the frequent words, class sums and one set
of weights. All documents take part: they are counted, they train the network and they are scored. Documents are dealt
by a hash of id and text into parts of about PART_CHARS characters and into ROUNDS rounds; in a round every part starts
from the common weights and runs mini-batch Adagrad over every token of its documents, in the order of the hash, and
the parts' weights are averaged by token count. So scores don't depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare

CLUSTERS, WIDTH, CONTEXTS, RARE_INPUTS = 64, 64, 64, 512
TOP, CLASSES = CLUSTERS * WIDTH, CLUSTERS + CONTEXTS
BORDER, CELLS = TOP + RARE_INPUTS, 1 << 20
SIDE, HIDDEN, RATE = 2, 24, 0.08
ROUNDS, LEAST_PARTS, LEAST_BUCKETS = 2, 8, 64
PART_CHARS, BUCKET_CHARS = 24 << 20, 4 << 20
BLOCK, SCORED, RUN, CHUNK, SLICES = 8192, 16384, 512, 4 << 20, 16
REACH, LONGEST = 1 << 17, 1024  # bytes of a text that are hashed in one go, and after which a word's places start anew
ALPHAS = np.geomspace(0.01, 2.0, 24)
_SHAPES = [(2 * SIDE, BORDER + 1, HIDDEN), (HIDDEN, CLASSES), (CLASSES,), (CLUSTERS, HIDDEN, WIDTH), (CLUSTERS, WIDTH)]
_ENDS = np.cumsum([int(np.prod(s)) for s in _SHAPES]).tolist()
_RNG = np.random.default_rng(31)
_BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(REACH, _FACTOR, np.uint64))
_INVERSES = np.cumprod(np.full(REACH, pow(_FACTOR, -1, 1 << 64), np.uint64)) * np.uint64(_FACTOR)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_LOW = np.uint64(CONTEXTS - 1)
_ROWS, _ONES = np.arange(RUN), np.ones(max(CLASSES, WIDTH), np.float32)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words, cut at ASCII white space; the low 6 of the 64 bits are 0."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    first = ~space
    first[1:] &= space[:-1]
    starts = np.nonzero(first)[0]
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw, starts = raw[starts[0] :], starts - starts[0]
    # each word's bytes by their place in it; white space after a word adds nothing
    if len(raw) <= REACH and (starts[1:] - starts[:-1]).max(initial=len(raw) - starts[-1]) <= LONGEST:
        h = np.add.reduceat(_BYTES.take(raw) * _POWERS[: len(raw)], starts)
        h *= _INVERSES[starts]  # places were counted from the text's start
    else:
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
        place &= LONGEST - 1
        h = np.add.reduceat(_BYTES[raw] * _POWERS[place], starts)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & ~_LOW


def contexts_of(hashes: np.ndarray) -> np.ndarray:
    """For each word of a text, what stands before it: one of CONTEXTS numbers, 0 at the start."""
    return np.concatenate([np.zeros(1, np.uint64), (hashes[:-1] >> np.uint64(6)) & _LOW]) if len(hashes) else hashes


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(12)).astype(np.int64) & (CELLS - 1)


def start(seed: int = 5) -> np.ndarray:
    """The common first weights, flat."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(_ENDS[-1], np.float32)
    inputs, out, _, words, _ = parts(flat)
    inputs[:] = rng.normal(0, 0.3, inputs.shape)
    out[:] = rng.normal(0, 0.1, out.shape)
    words[:] = rng.normal(0, 0.1, words.shape)
    return flat


def parts(flat: np.ndarray) -> list[np.ndarray]:
    """Views: input vectors by position, class weights, class biases, word weights and biases by cluster."""
    return [x.reshape(s) for x, s in zip(np.split(flat, _ENDS[:-1]), _SHAPES, strict=True)]


@dataclass
class Vocabulary:
    """The frequent words by hash, where each stands, and which outputs exist (0, or minus infinity)."""

    hashes: np.ndarray
    place: np.ndarray
    class_mask: np.ndarray
    word_mask: np.ndarray

    def __post_init__(self):
        """Direct tables from two parts of the hash to the word; the second holds those whose place in the first is taken."""
        self.first, self.second = np.full(CELLS, -1, np.int16), np.full(CELLS, -1, np.int16)
        self.rest = []
        for k, (one, two) in enumerate(zip(cell_of(self.hashes).tolist(), self.other_cell(self.hashes).tolist(), strict=True)):
            if self.first[one] < 0:
                self.first[one] = k
            elif self.second[two] < 0:
                self.second[two] = k
            else:
                self.rest.append(k)

    @staticmethod
    def other_cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(40)).astype(np.int64) & (CELLS - 1)

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """The place (cluster * WIDTH + slot) of each frequent word, -1 for the others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        k = self.first.take(cell_of(hashes))
        out = np.where(self.hashes.take(k) == hashes, self.place.take(k), np.int32(-1))  # at -1 stands the last word: equal only if it is the one asked for
        some = np.nonzero(out < 0)[0]
        odd = hashes[some]
        k = self.second.take(self.other_cell(odd))
        found = np.nonzero(self.hashes.take(k) == odd)[0]
        out[some[found]] = self.place[k[found]]
        for k in self.rest:
            out[hashes == self.hashes[k]] = self.place[k]
        return out


def vocabulary(hashes: np.ndarray, near: np.ndarray) -> Vocabulary:
    """Clusters the frequent words, given from the most frequent on, by their context counts: halved again and again at the median of the first principal component."""
    n = len(hashes)
    x = np.log1p(near.astype(np.float64))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    groups = [np.arange(n)]
    while max(map(len, groups), default=0) > WIDTH:
        halved = []
        for g in groups:
            if len(g) <= WIDTH:
                halved.append(g)
                continue
            c = x[g] - x[g].mean(0)
            axis = np.linalg.eigh(c.T @ c)[1][:, -1]
            axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
            order = g[np.lexsort((g, np.round(c @ axis, 9)))]
            half = -(-len(g) // (2 * WIDTH)) * WIDTH
            halved += [order[:half], order[half:]]
        groups = halved
    place, word_mask, class_mask = np.zeros(n, np.int32), np.full((CLUSTERS, WIDTH), -np.inf, np.float32), np.zeros(CLASSES, np.float32)
    groups = [g for g in groups if len(g)]
    for k, g in enumerate(groups):
        place[g] = k * WIDTH + np.arange(len(g))
        word_mask[k, : len(g)] = 0
    class_mask[len(groups) : CLUSTERS] = -np.inf
    word_mask[len(groups) :] = 0  # of clusters that don't exist
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], place[order], class_mask, word_mask)


def windows(inputs: np.ndarray) -> np.ndarray:
    """The inputs of each token's neighbours: 2 * SIDE columns."""
    padded = np.concatenate([np.full(SIDE, BORDER, np.int32), inputs, np.full(SIDE, BORDER, np.int32)])
    n = len(inputs)
    return np.stack([padded[SIDE + k : SIDE + k + n] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)


def _bounded(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether no logit of hidden values within [-1, 1] can overflow: then no row's maximum need be taken off."""
    return (np.abs(weights).sum(-2) + np.abs(bias)).max(-1) < 60


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights, and the biases as one more row, that of a hidden value of 1."""
    return np.concatenate([weights, bias[..., None, :]], -2)


def _logits(h: np.ndarray, weights: np.ndarray, bounded: bool, space: np.ndarray) -> np.ndarray:
    """Of at most RUN rows, in the given space, which the next ones use again: it stays in a core's cache."""
    z = np.matmul(h, weights, out=space[: len(h) * weights.shape[1]].reshape(len(h), -1))
    if not bounded:
        z -= z.max(1, keepdims=True)
    return z


def _hidden(inputs: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The hidden values of each token, and a last one of 1; `around` has a row for each neighbour."""
    h = np.ones((around.shape[1], HIDDEN + 1), np.float32)
    z = inputs[0].take(around[0], axis=0)
    for k in range(1, 2 * SIDE):
        z += inputs[k].take(around[k], axis=0)
    np.tanh(z, out=h[:, :HIDDEN])
    return h


def _sorted(around: np.ndarray, classes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by class: their order, and of each its neighbours (a row each), class and slot."""
    order = _order(classes)
    return order, np.ascontiguousarray(around.take(order, axis=0).T, np.intp), classes[order], place[order] % WIDTH


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of small numbers (inputs, classes): numpy sorts 16 bits by digits."""
    return np.argsort(keys.astype(np.int16), kind="stable")


def _runs(a: int, b: int) -> Iterator[slice]:
    yield from (slice(k, min(b, k + RUN)) for k in range(a, b, RUN))


def _clusters(classes: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each cluster among the sorted classes, with the rows that it has, in runs."""
    ends = np.searchsorted(classes, np.arange(CLUSTERS + 1)).tolist()
    yield from ((c, rows) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) for rows in _runs(a, b))


def log_probabilities(flat: np.ndarray, words: Vocabulary, around: np.ndarray, classes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log-probability of each token's class and, for frequent words, of the word in its cluster."""
    inputs, out, bias, word_out, word_bias = parts(flat)
    both, safe = _with_bias(out, bias + words.class_mask), _bounded(out, bias)
    word_both, word_safe = _with_bias(word_out, word_bias + words.word_mask), _bounded(word_out, word_bias)
    total, space = np.zeros(len(classes)), np.empty(RUN * max(CLASSES, WIDTH), np.float32)

    def chunk(around: np.ndarray, classes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, near, of, slot = _sorted(around, classes, place)
        h = _hidden(inputs, near)
        own, sums = np.empty(len(h), np.float32), np.empty(len(h), np.float32)

        def ask(rows: slice, weights: np.ndarray, bounded: bool, names: np.ndarray) -> None:
            z = _logits(h[rows], weights, bounded, space)
            own[rows] = z.ravel().take(_ROWS[: len(z)] * z.shape[1] + names[rows])
            np.matmul(np.exp(z, out=z), _ONES[: z.shape[1]], out=sums[rows])

        for rows in _runs(0, len(h)):
            ask(rows, both, safe, of)
        got, frequent = (own - np.log(sums)).astype(np.float64), np.searchsorted(of, CLUSTERS)
        for c, rows in _clusters(of):
            ask(rows, word_both[c], word_safe[c], slot)
        got[:frequent] += own[:frequent] - np.log(sums[:frequent])
        return order, got

    for at in range(0, len(classes), SCORED):
        order, got = chunk(*(x[at : at + SCORED] for x in (around, classes, place)))
        total[at + order] = got
    return total


def learn(flat: np.ndarray, memory: np.ndarray, words: Vocabulary, around: np.ndarray, classes: np.ndarray, place: np.ndarray) -> None:
    """One Adagrad step on a block of tokens, in place; weights that the block doesn't meet stay as they are."""
    n = len(classes)
    _, near, of, slot = _sorted(around, classes, place)
    (inputs, out, bias, word_out, word_bias), (m_inputs, m_out, m_bias, m_word, m_wbias) = parts(flat), parts(memory)
    h, space = _hidden(inputs, near), np.empty(RUN * max(CLASSES, WIDTH), np.float32)

    def step(w: np.ndarray, m: np.ndarray, g: np.ndarray) -> None:
        g /= n
        m += g * g
        root = np.sqrt(m)
        root += 1e-6
        g *= RATE
        g /= root
        w -= g

    def errors(rows: slice, weights: np.ndarray, bounded: bool, names: np.ndarray) -> np.ndarray:
        """The softmax, less 1 at the outcome."""
        g = _logits(h[rows], weights, bounded, space)
        np.exp(g, out=g)
        g /= (g @ _ONES[: g.shape[1]])[:, None]
        g.ravel()[_ROWS[: len(g)] * g.shape[1] + names[rows]] -= 1
        return g

    both, safe = _with_bias(out, bias + words.class_mask), _bounded(out, bias)
    word_both, word_safe = _with_bias(word_out, word_bias + words.word_mask), _bounded(word_out, word_bias)
    back, g_both, g_word = np.empty((n, HIDDEN), np.float32), np.zeros_like(both), np.zeros_like(word_both)
    for rows in _runs(0, n):
        g = errors(rows, both, safe, of)
        np.matmul(g, out.T, out=back[rows])
        g_both += h[rows].T @ g
    for c, rows in _clusters(of):
        g = errors(rows, word_both[c], word_safe[c], slot)
        back[rows] += g @ word_out[c].T
        g_word[c] += h[rows].T @ g
    step(word_out, m_word, g_word[:, :HIDDEN])
    step(word_bias, m_wbias, g_word[:, HIDDEN])
    step(out, m_out, g_both[:HIDDEN])
    step(bias, m_bias, g_both[HIDDEN])
    h = h[:, :HIDDEN]
    back *= 1 - h * h
    pairs, into = back.view(np.complex64).ravel(), np.empty((BORDER + 1, HIDDEN), np.float32)  # two numbers are added at once
    for k in range(2 * SIDE):
        into[:] = 0
        np.add.at(into.view(np.complex64).ravel(), (near[k][:, None] * (HIDDEN // 2) + _ROWS[: HIDDEN // 2]).ravel(), pairs)
        step(inputs[k], m_inputs[k], into)


@dataclass
class WindowModel:
    """The network, the class of each cell, and of the rare words' classes: tokens, distinct words and smoothing."""

    words: Vocabulary
    weights: np.ndarray
    cells: np.ndarray
    tokens_of: np.ndarray
    words_of: np.ndarray
    alpha: float

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place (-1 where rare), output class and input of each word."""
        h = word_hashes(text)
        place = self.words.rank(h)
        rare = place < 0
        classes, inputs = place // WIDTH, place.copy()
        odd = h[rare]
        classes[rare] = CLUSTERS + self.cells[cell_of(odd)].astype(np.int32)
        inputs[rare] = TOP + ((odd >> np.uint64(32)) & np.uint64(RARE_INPUTS - 1)).astype(np.int32)
        return h, place, classes, inputs

    def networks(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[float]:
        """Of texts that were read, all of the score but the rare words' counts; texts go through the network together."""
        n = [len(f[0]) for f in found]
        if not sum(n):
            return [0.0] * len(n)
        place, classes = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        got = log_probabilities(self.weights, self.words, np.concatenate([windows(f[3]) for f in found]), classes, place)
        sums = [float(x.sum()) for x in np.split(got, np.cumsum(n)[:-1])]
        for k, (_, p, c, _) in enumerate(found):
            own = np.bincount(c[p < 0] - CLUSTERS, minlength=CONTEXTS)
            sums[k] -= float((own * np.log(self.tokens_of - own + self.alpha * (self.words_of + 1)))[own > 0].sum())
        return sums


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def document_key(doc_id: int | None, text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc_id}:{text or ''}".encode("utf-8", "replace")) >> 1


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each bucket with its part of the columns, as bytes."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True) if len(names) else ():
        yield name, *(c[rows].tobytes() for c in columns)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    names, starts = np.unique(keys[order], return_index=True)
    return names, np.add.reduceat(counts[order], starts) if len(names) else counts[:0]


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


@dataclass
class Counts:
    """What is known of the corpus's words."""

    words: Vocabulary
    cells: np.ndarray
    tokens_of: np.ndarray
    words_of: np.ndarray
    alpha: float


def corpus_counts(texts: DataFrame, buckets: int) -> Counts:
    """Counts every word and what stands before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = list(zip(*_packed(cell_of(keys) % buckets, keys, n.astype(np.int64)), strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "keys", "n"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                h = word_hashes(t.as_py())
                held.append(h | contexts_of(h))
                size += len(h)
                if size >= CHUNK:
                    yield pack()
                    held, size = [], 0
        if size:
            yield pack()

    most = 4 * TOP // buckets + 8  # of a bucket's words, far more than its part of the frequent ones

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _sums(_joined(pdf["keys"], np.uint64), _joined(pdf["n"], np.int64))
        cell, m = _sums(cell_of(keys) * CONTEXTS + (keys & _LOW).astype(np.int64), n)
        order = np.lexsort((cell, -m, cell // CONTEXTS))  # of a cell the context with most tokens, then the smaller
        cells, at = np.unique(cell[order] // CONTEXTS, return_index=True)
        mode = (cell[order][at] % CONTEXTS).astype(np.uint8)
        words, total = _sums(keys & ~_LOW, n)
        of = mode[np.searchsorted(cells, cell_of(words))]
        top = np.lexsort((words, -total))[:most]
        near = np.zeros((len(top), CONTEXTS), np.int32)
        place = np.full(len(words), -1)
        place[top] = np.arange(len(top))
        where = place[np.searchsorted(words, keys & ~_LOW)]
        near[where[where >= 0], (keys & _LOW).astype(np.int64)[where >= 0]] = n[where >= 0]
        sizes, of_size = np.unique(total, return_counts=True)
        row = {"cells": cells.astype(np.int32), "mode": mode, "tokens": np.bincount(of, total, CONTEXTS), "words": np.bincount(of, minlength=CONTEXTS).astype(float), "top": words[top], "n": total[top], "near": near, "sizes": sizes, "of_size": of_size}
        return pd.DataFrame({k: [np.ascontiguousarray(v).tobytes()] for k, v in row.items()})

    kind = ", ".join(f"{c} binary" for c in ("cells", "mode", "tokens", "words", "top", "n", "near", "sizes", "of_size"))
    rows = texts.select("text").mapInArrow(count, "bucket int, keys binary, n binary").groupBy("bucket").applyInPandas(gather, kind).toPandas()  # class sums, frequent words, counts of counts
    cells, tokens_of, words_of = np.zeros(CELLS, np.uint8), np.zeros(CONTEXTS), np.zeros(CONTEXTS)
    if not len(rows):
        return Counts(vocabulary(np.zeros(0, np.uint64), np.zeros((0, CONTEXTS))), cells, tokens_of, words_of, 1.0)
    cells[_joined(rows["cells"], np.int32)] = _joined(rows["mode"], np.uint8)
    tokens_of += _joined(rows["tokens"], float).reshape(-1, CONTEXTS).sum(0)
    words_of += _joined(rows["words"], float).reshape(-1, CONTEXTS).sum(0)
    top, n, near = _joined(rows["top"], np.uint64), _joined(rows["n"], np.int64), _joined(rows["near"], np.int32).reshape(-1, CONTEXTS)
    first = np.lexsort((top, -n))[:TOP]
    own = cells[cell_of(top[first])]
    tokens_of -= np.bincount(own, n[first], CONTEXTS)
    words_of -= np.bincount(own, minlength=CONTEXTS)
    sizes, of_size = _sums(_joined(rows["sizes"], np.int64), _joined(rows["of_size"], np.int64))
    of_size = of_size - np.bincount(np.searchsorted(sizes, n[first]), minlength=len(sizes))
    return Counts(vocabulary(top[first], near[first]), cells, tokens_of, words_of, smoothing(sizes[of_size > 0], of_size[of_size > 0]))


def smoothing(n: np.ndarray, w: np.ndarray) -> float:
    """The smoothing under which the rare words' counts, each token left out in turn, are most likely; w words have count n."""
    if not len(n):
        return 1.0
    n, w = n.astype(float), w.astype(float)
    tokens, words = (n * w).sum(), w.sum()
    return float(max(ALPHAS, key=lambda a: (w * n * (np.log(n - 1 + a) - np.log(tokens - 1 + a * (words + 1)))).sum()))


def _train_part(shared):
    """A function over the documents of one part in one round: slices of its weights, and its tokens."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        flat, memory, held, n, seen = model.weights.copy(), np.full_like(model.weights, 1e-6), [], 0, 0

        def step(least: int) -> None:
            """Learns from the held tokens in blocks; a rest of fewer than `least` is held on."""
            nonlocal held, n
            tokens = [np.concatenate(x) for x in zip(*held, strict=True)]
            at = 0
            while n - at >= least:
                learn(flat, memory, model.words, *(x[at : at + BLOCK] for x in tokens))
                at = min(n, at + BLOCK)
            held, n = [[x[at:] for x in tokens]], n - at

        keys = [document_key(None if pd.isna(i) else int(i), t) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
        for k in sorted(range(len(keys)), key=keys.__getitem__):
            _, place, classes, inputs = model.read(pdf["text"].iloc[k])
            held.append((windows(inputs), classes, place))
            n, seen = n + len(classes), seen + len(classes)
            if n >= BLOCK:
                step(BLOCK)
        if n:
            step(1)
        w = np.split(flat, np.linspace(0, len(flat), SLICES + 1).astype(int)[1:-1])
        return pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "w": [x.tobytes() for x in w], "n": np.full(SLICES, seen, np.int64)})

    return run


def _mean_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for k, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            into = sums.setdefault(k, [0.0, 0])
            into[0], into[1] = into[0] + np.frombuffer(w, np.float32).astype(np.float64) * n, into[1] + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(w / max(1, n)).astype(np.float32).tobytes() for w, n in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["slice", "w", "n"])


def _amount(texts: DataFrame, each: int, least: int) -> int:
    return max(least, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // each))


def bucket_number(texts: DataFrame) -> int:
    """A power of two that grows with the text."""
    return min(CELLS, 1 << (_amount(texts, BUCKET_CHARS, LEAST_BUCKETS) - 1).bit_length())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> WindowModel:
    """Counts the corpus, classes its words and trains the network on all of it."""
    prepare(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    c = corpus_counts(texts, bucket_number(texts))
    model = WindowModel(c.words, start(), c.cells, c.tokens_of, c.words_of, c.alpha)
    deal = F.xxhash64("doc_id", "text")
    dealt = texts.filter(F.length("text") > 0).select("doc_id", "text", F.pmod(deal, F.lit(_amount(texts, PART_CHARS, LEAST_PARTS))).alias("part"), F.pmod(F.shiftright(deal, 40), F.lit(ROUNDS)).alias("round"))
    for r in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        got = dealt.filter(F.col("round") == r).select("part", "doc_id", "text").groupBy("part").applyInPandas(_train_part(shared), "slice int, w binary, n long")
        means = sorted(got.repartition(SLICES, "slice").mapInArrow(_mean_slices, "slice int, w binary, n long").collect())  # SLICES rows
        if means and means[0]["n"]:
            weights = np.concatenate([np.frombuffer(m["w"], np.float32) for m in means])
            model = WindowModel(model.words, weights, model.cells, model.tokens_of, model.words_of, model.alpha)
    return model


def score(docs: DataFrame, model: WindowModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the documents, which are those that the model is of: doc_id, n_tokens, pll (sum of log-probabilities), pll_per_token, n_novel (tokens of words that no other row has), novel_share.

    Null and empty texts and texts without words have 0 tokens, a sum of 0 and no mean or share. Null and repeated
    ids pass through, and rows that repeat a text count as other rows; other columns are ignored; an empty table
    gives an empty table.
    """
    prepare(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    buckets = bucket_number(texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads documents in chunks: a row for each bucket with the chunk's rare words, and one of bucket -1 with the rest of the scores."""
        chunk = TaskContext.get().partitionId() << 32

        def pack() -> pa.RecordBatch:
            h, doc, own = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = [(chunk, b, *x, *[None] * 4) for b, *x in _packed(cell_of(h) % buckets, h, doc, own)]
            whole = (np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), np.array(sizes, np.int64), np.array(nets, float))
            rows.append((chunk, -1, b"", b"", b"", *(x.tobytes() for x in whole)))
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 7)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "bucket", "h", "doc", "own", "ids", "unnamed", "sizes", "nets"])

        held, ids, sizes, nets, size = [], [], [], [], 0
        for batch in batches:
            found = [shared.value.read(t.as_py()) for t in batch.column(1)]
            for k, (h, place, *_) in enumerate(found):
                rare, own = np.unique(h[place < 0], return_counts=True)
                held.append((rare, np.full(len(rare), len(ids) + k, np.int32), own.astype(np.int32)))
                size += len(rare)
            ids += batch.column(0).to_pylist()
            sizes += [len(f[0]) for f in found]
            nets += shared.value.networks(found)
            if size >= CHUNK:
                yield pack()
                chunk, held, ids, sizes, nets, size = chunk + 1, [], [], [], [], 0
        if ids:
            yield pack()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact counts of a bucket's words, and for each chunk its documents' summed logarithms of smoothed counts elsewhere and novel tokens."""
        if pdf["bucket"].iloc[0] < 0:
            return pdf[["chunk", "ids", "unnamed", "sizes", "nets"]].assign(doc=None, share=None, novel=None)
        h, own = _joined(pdf["h"], np.uint64), _joined(pdf["own"], np.int32).astype(np.int64)
        names, n = _sums(h, own)
        elsewhere = n[np.searchsorted(names, h)] - own
        share, novel = own * np.log(elsewhere + shared.value.alpha), own * (elsewhere == 0)
        out, at = [], 0
        for chunk, doc in zip(pdf["chunk"], pdf["doc"], strict=True):
            doc = np.frombuffer(doc, np.int32)
            cut = slice(at, at + len(doc))
            some, inverse = np.unique(doc, return_inverse=True)
            out.append((chunk, *[None] * 4, some.tobytes(), np.bincount(inverse, share[cut]).tobytes(), np.bincount(inverse, novel[cut]).astype(np.int64).tobytes()))
            at += len(doc)
        return pd.DataFrame(out, columns=["chunk", "ids", "unnamed", "sizes", "nets", "doc", "share", "novel"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf[pdf["sizes"].notna()].iloc[0]
        n, pll = np.frombuffer(rest["sizes"], np.int64), np.frombuffer(rest["nets"], float).copy()
        novel = np.zeros(len(n), np.int64)
        for d, s, k in zip(pdf["doc"], pdf["share"], pdf["novel"], strict=True):
            if d is not None:
                doc = np.frombuffer(d, np.int32)
                pll[doc] += np.frombuffer(s, float)
                novel[doc] += np.frombuffer(k, np.int64)
        ids = pd.arrays.IntegerArray(np.frombuffer(rest["ids"], np.int64).copy(), np.frombuffer(rest["unnamed"], bool).copy())
        return pd.DataFrame({"doc_id": ids, "n_tokens": n, "pll": np.where(n > 0, pll, 0.0), "n_novel": novel})

    asked = texts.mapInArrow(ask, "chunk long, bucket int, h binary, doc binary, own binary, ids binary, unnamed binary, sizes binary, nets binary")
    dealt = asked.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("chunk")).alias("apart"))  # the rest of a chunk is a group of its own
    found = dealt.applyInPandas(answer, "chunk long, ids binary, unnamed binary, sizes binary, nets binary, doc binary, share binary, novel binary")
    rows = found.groupBy("chunk").applyInPandas(add, "doc_id long, n_tokens long, pll double, n_novel long")
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return rows.select("doc_id", "n_tokens", "pll", mean("pll").alias("pll_per_token"), "n_novel", mean("n_novel").alias("novel_share"))
