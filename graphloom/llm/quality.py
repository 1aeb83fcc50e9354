"""A document quality classifier on random-indexing word vectors.

Words (letter runs with their case shape, digit runs, symbol runs) are hashed to BUCKETS. Every bucket has a
fixed sparse ternary index vector; a word's vector is the sum of its neighbours' index vectors over all documents,
labelled or not. The sums add up over partitions: each task makes a partial table of fixed size, and a shuffle adds
them by slices of buckets, so the driver gets one table whatever the number of tasks. A document is
pooled to the frequency-damped mean and spread of its words' vectors and its log length. A two-layer network,
trained in numpy, scores the pooled vector, and a temperature fitted on rows that it wasn't trained on turns
its output into calibrated probabilities. The network is fitted on at most SAMPLE labelled rows, first by a hash of
the id; word vectors and scoring read every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Memo, kept, prepare

BUCKETS, DIM, NONZERO, WINDOW, DAMP = 1 << 14, 48, 4, 2, 1e-3
SAMPLE, PARTS, HIDDEN, EPOCHS = 6000, 8, 24, 60
#: The partial tables are added in so many slices of buckets.
SLICES = 16
#: Words counted at once.
BLOCK = 100_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _bucket(word: str) -> int:
    """Rare word forms share a bucket by shape and hash; symbols and digits by length too."""
    if word.isdigit():
        word = f"<digits {min(len(word), 20)}>"
    elif word.isupper() and len(word) > 1:
        word = f"<upper {zlib.crc32(word.encode()) % 64}>"
    elif not word[0].isalpha():
        word = f"<symbol {word[:4]}>"
    return zlib.crc32(word.encode()) % BUCKETS


_WORDS = Memo(_bucket, 300_000)


def word_buckets(text: str | None) -> np.ndarray:
    found = WORD.findall(text or "")
    return np.fromiter(map(_WORDS.__getitem__, found), np.int32, len(found))


def index_vectors(seed: int = 11) -> np.ndarray:
    """A sparse ternary vector for each bucket."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIM), np.float32)
    where = np.argsort(rng.random((BUCKETS, DIM)), 1)[:, :NONZERO]
    np.put_along_axis(table, where, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), 1)
    return table


def context_sums(texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Summed index vectors of the neighbours, and the count, of each bucket. Texts are counted in blocks, BUCKETS between them."""
    index, sums, counts = index_vectors(), np.zeros((BUCKETS + 1) * DIM), np.zeros(BUCKETS + 1, np.int64)
    where = np.vstack([np.nonzero(index)[1].reshape(BUCKETS, NONZERO), np.zeros((1, NONZERO), np.int64)])
    sign = np.vstack([np.take_along_axis(index, where[:-1], 1), np.zeros((1, NONZERO))]).astype(np.float64)
    gap, block, held = np.full(WINDOW, BUCKETS, np.int32), [], 0

    def add() -> None:
        ids = np.concatenate([gap, *block]).astype(np.int64)
        counts[:] += np.bincount(ids, minlength=BUCKETS + 1)
        for k in range(1, WINDOW + 1):
            at, near = np.concatenate([ids[:-k], ids[k:]]) * DIM, np.concatenate([ids[k:], ids[:-k]])
            for n in range(NONZERO):
                sums[:] += np.bincount(at + where[near, n], sign[near, n], len(sums))
        block.clear()

    for text in texts:
        ids = word_buckets(text)
        block += [ids, gap]
        held += len(ids) + WINDOW
        if held >= BLOCK:
            add()
            held = 0
    add()
    return sums.reshape(-1, DIM)[:-1], counts[:-1]


def corpus_sums(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """context_sums of the one string column over all rows."""
    width = BUCKETS // SLICES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = context_sums(t.as_py() for batch in batches for t in batch.column(0))
        for k in range(SLICES):
            at = slice(k * width, (k + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s[at].tobytes()], pa.binary()), pa.array([c[at].tobytes()], pa.binary())], ["slice", "sums", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, s, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                into = held.setdefault(k, [np.zeros((width, DIM)), np.zeros(width, np.int64)])
                into[0] += np.frombuffer(s, np.float64).reshape(width, DIM)
                into[1] += np.frombuffer(c, np.int64)
        for k, (s, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["slice", "sums", "counts"])

    kind = "slice int, sums binary, counts binary"
    total, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS, np.int64)
    for row in texts.mapInArrow(part, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect():
        at = slice(row["slice"] * width, (row["slice"] + 1) * width)
        total[at] += np.frombuffer(row["sums"], np.float64).reshape(width, DIM)
        counts[at] += np.frombuffer(row["counts"], np.int64)
    return total, counts


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit context vectors plus the word's own index vector, damped by frequency."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(norm > 0, norm, 1) + index_vectors() / np.sqrt(NONZERO)
    return (unit * (DAMP / (DAMP + counts / max(1, counts.sum())))[:, None]).astype(np.float32)


def pooled(vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Mean, spread and log length; zeros for a text without words."""
    ids = word_buckets(text)
    if not len(ids):
        return np.zeros(2 * DIM + 1, np.float32)
    x = vectors[ids]
    mean = x.mean(0)
    return np.concatenate([mean, np.sqrt(np.maximum((x * x).mean(0) - mean * mean, 0)), [np.log1p(len(ids))]]).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logit(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.logit(np.stack([pooled(self.vectors, t) for t in texts])) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 3) -> QualityModel:
    """A two-layer network by mini-batch Adam on four fifths of the rows; the rest sets the temperature.

    Without rows every score is 0.5; with rows of one label it is that label's smoothed share, whatever the text.
    """
    n, width = features.shape
    if len(set(labels.tolist())) < 2:
        prior = float(np.log(n + 1) * (2 * int(labels[0]) - 1)) if n else 0.0
        return QualityModel(vectors, np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior), 1.0)
    rng = np.random.default_rng(seed)
    held = np.arange(n) % 5 == 4
    fitted = ~held if held.any() else np.ones(n, bool)
    centre, scale = features[fitted].mean(0), features[fitted].std(0) + 1e-6
    x, y = ((features - centre) / scale)[fitted], labels[fitted].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            h = np.tanh(x[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [x[rows].T @ back + 3e-4 * p[0], back.sum(0), h.T @ g + 3e-4 * p[2], g.sum()]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - 0.004 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = QualityModel(vectors, centre, scale, (p[0], p[1], p[2], float(p[3])), 1.0)
    test = held if held.any() else fitted
    z, truth = model.logit(features[test]), labels[test]
    loss = lambda s: np.logaddexp(0, np.where(truth == 1, -z, z) / s).mean()
    model.temperature = float(min(np.geomspace(0.3, 10, 71), key=loss))
    return model


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Word vectors of all documents, and a network fitted on at most `sample` labelled ones; a document labelled more than once counts with its lowest label."""
    prepare(docs.sparkSession)
    marked = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if learn is not None:
        marked = marked.filter(learn)
    chosen = marked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # bounded: `sample` ids are broadcast, and as many texts kept in PARTS partitions
    rows = kept(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(PARTS))

    total, counts = corpus_sums(texts.select("text"))
    vectors = word_vectors(total, counts)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pooled(shared.value, t.as_py()) for t in batch.column(2)], pa.list_(pa.float32()))], ["doc_id", "label", "features"])

    got = rows.select("doc_id", "label", "text").mapInArrow(pool, "doc_id long, label int, features array<float>").toArrow()
    order = sorted(range(got.num_rows), key=lambda n: (got["doc_id"][n].as_py() * 2654435761 % 2**32))
    features = np.array([got["features"][n].as_py() for n in order], np.float64).reshape(-1, 2 * DIM + 1)
    return fit(features, np.array([got["label"][n].as_py() for n in order]), vectors)


def score_quality(docs: DataFrame, model: QualityModel, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1), predicted (1 if score >= cut).

    Null and empty texts are scored as texts without words; null and repeated ids pass through; other columns
    are ignored; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
