"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and its bytes other than letters become spaces; every run of 3 or 4 bytes inside a word
and its borders is hashed to one of BUCKETS embeddings; the average embedding goes through a linear softmax.
Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded, hash-ordered sample
of labelled rows for each language (PER_LANGUAGE rows at most). A fifth of the sample isn't trained on: whole texts
and excerpts of them of EXCERPTS characters set the temperature, which falls with the number of subwords, and for each
class of lengths two bounds of rejection. A prediction is rejected if its probability is below the lowest at which at
most ERROR of the held-out predictions are wrong, or if a smaller share of its subwords is known from the trained texts
than SPARE times what the least familiar held-out text lacked allows: the one for texts too short to tell, the other for
languages that weren't learned and for strings that aren't language. Both hold for any number of languages.
Because the model is linear after averaging, executors get one table of BUCKETS x languages: its size doesn't
grow with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bucket_of_id, prepare, settle, settle_driver

BUCKETS, DIM, ORDERS = 1 << 15, 16, (3, 4)
PER_LANGUAGE, EPOCHS, RATE = 500, 12, 4.0
#: Lengths of the calibration excerpts, and the subword counts from which on the classes of length begin.
EXCERPTS, CLASSES = (4, 12, 40, 160, 600), (0, 24, 96, 384)
#: Wrong predictions tolerated among those that aren't rejected; what familiarity may fall short of, times the worst held-out text; the highest bound of probability.
ERROR, SPARE, CEILING = 0.1, 2.5, 0.95
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
_KEEP = np.full(256, 32, np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of a whole text."""
    codes = _KEEP[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    codes, space = codes[keep], space[keep]
    out = []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = codes[:size] + np.uint32(n)
        inside = np.ones(size, bool)
        for k in range(1, n):
            h = h * np.uint32(1000003) + codes[k : k + size]
            if k < n - 1:
                inside &= ~space[k : k + size]
        h = h[inside] * np.uint32(2654435761)
        out.append(h >> np.uint32(32 - 15))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


@dataclass
class LanguageModel:
    """What prediction needs: logits of each bucket, which buckets are known, languages, sharpness by length, bounds by class of length."""

    table: np.ndarray
    known: np.ndarray
    languages: list[str]
    sharpness: tuple[float, float]
    least_sure: list[float]
    least_known: list[float]

    def probabilities(self, logits: np.ndarray, n) -> np.ndarray:
        """Calibrated probabilities of mean logits over n subwords."""
        scale, power = self.sharpness
        return _softmax(logits * scale * np.maximum(n, 1.0) ** power)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language (of equal ones the first by name), calibrated probability, whether it is rejected; `und`, 0 and rejected where no letter is."""
        if not text or not LETTER.search(text) or not self.languages:
            return UNDETERMINED, 0.0, True
        found = subwords(text)
        n = len(found)
        p = self.probabilities(self.table[found].mean(0, dtype=np.float64) if n else np.zeros(len(self.languages)), n)
        best, k = int(p.argmax()), length_class(n)
        unknown = not n or self.known[found].mean() < self.least_known[k]
        return self.languages[best], float(p[best]), bool(p[best] < self.least_sure[k] or unknown)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


Row = tuple[np.ndarray, np.ndarray, str]


def train(rows: list[tuple[Row, list[Row]]], seed: int = 7) -> LanguageModel:
    """rows: distinct buckets, their counts and the language of each labelled text and of its excerpts, in a fixed order."""
    rows = [r for r in rows if len(r[0][0])]
    languages = sorted({r[0][2] for r in rows})
    k = len(languages)
    if not k:
        return LanguageModel(np.zeros((BUCKETS, 0), np.float32), np.zeros(BUCKETS, bool), [], (1.0, 0.0), [0.0] * len(CLASSES), [0.0] * len(CLASSES))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight = np.zeros((DIM, k))
    fit = [(i, (c / c.sum()).astype(np.float32), languages.index(lang)) for n, ((i, c, lang), _) in enumerate(rows) if n % 5 != 4]
    held = [r for n, (whole, parts) in enumerate(rows) if n % 5 == 4 for r in (whole, *parts) if len(r[0])] or [r[0] for r in rows]
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for n in rng.permutation(len(fit)):
            index, share, y = fit[n]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ embed[index]
            g = _softmax(mean @ weight)
            g[y] -= 1
            back = weight @ g
            weight -= rate * np.outer(mean, g)
            embed[index] -= rate * share[:, None] * back
    table, known = embed @ weight, np.zeros(BUCKETS, bool)
    for index, *_ in fit:
        known[index] = True
    model = LanguageModel(table.astype(np.float32), known, languages, (1.0, 0.0), [], [])
    calibrate(model, held)
    return model


def calibrate(model: LanguageModel, held: list[Row]) -> None:
    """Sets sharpness and bounds by texts that the model wasn't trained on."""
    logits = np.array([c @ model.table[i] / c.sum() for i, c, _ in held], np.float64)
    sizes, truth = np.array([c.sum() for _, c, _ in held]), np.array([model.languages.index(lang) for *_, lang in held])
    familiar = np.array([c @ model.known[i] / c.sum() for i, c, _ in held])
    k = len(model.languages)
    # targets short of certainty by one row's share keep the sharpness finite where no row is wrong
    target = np.full(logits.shape, 1 / (len(truth) + 2) / k)
    target[np.arange(len(truth)), truth] += 1 - 1 / (len(truth) + 2)

    def loss(sharpness: tuple[float, float]) -> float:
        model.sharpness = sharpness
        return -(target * np.log(model.probabilities(logits, sizes[:, None]) + 1e-12)).sum(1).mean()

    model.sharpness = min(((a, b) for b in (0.0, 0.25, 0.5, 0.75, 1.0) for a in np.geomspace(0.01, 50, 80).tolist()), key=loss)
    p = model.probabilities(logits, sizes[:, None])
    sure, right = p.max(1), p.argmax(1) == truth
    classes = np.array([length_class(n) for n in sizes])
    model.least_sure, model.least_known = [], []
    for c in range(len(CLASSES)):
        of = classes == c if (classes == c).sum() >= 20 else np.ones(len(classes), bool)
        order = np.argsort(-sure[of], kind="stable")
        wrong = np.cumsum(~right[of][order]) / np.arange(1, of.sum() + 1)
        some = np.nonzero(wrong <= ERROR)[0]
        bound = float(sure[of][order][some[-1]]) if len(some) and some[-1] < of.sum() - 1 else 0.0 if len(some) else CEILING
        model.least_sure.append(min(CEILING, bound))
        model.least_known.append(max(0.0, 1 - SPARE * (1 - float(familiar[of].min()))))


def labelled_sample(docs: DataFrame, learn: Column | None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[Row, list[Row]]]:
    """Subword counts of at most per_language labelled rows a language and of their excerpts, first by a hash of the id. Texts stay on the executors.

    Of a language with more rows, those with a hash under a bound that some twice per_language rows meet are ranked: no
    task gets all rows of a language.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = base.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (learn if learn is not None else F.lit(True)))
    draw = (F.xxhash64("doc_id") / F.lit(2.0**64)) + 0.5  # from 0 to 1, in the order of the hash
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.count(F.lit(1))).alias("share"))
    drawn = rows.select("doc_id", "lang").join(share, "lang").filter(draw <= F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).select("doc_id", "lang").distinct()
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # bounded: per_language rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count = [], []
            for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                starts = [(n, (i or 0) * 2654435761 % max(1, len(t) - n)) for n in EXCERPTS if n < len(t)]
                got = [np.unique(subwords(x), return_counts=True) for x in (t, *(t[at : at + n] for n, at in starts))]
                index.append([g[0].astype(np.int32) for g in got])
                count.append([g[1].astype(np.int32) for g in got])
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, kind), pa.array(count, kind)], ["lang", "doc_id", "buckets", "counts"])

    got = texts.mapInArrow(run, "lang string, doc_id long, buckets array<array<int>>, counts array<array<int>>").toArrow()
    order = sorted(range(got.num_rows), key=lambda n: (int(got["doc_id"][n].as_py() or 0) * 2654435761 % 2**32, got["lang"][n].as_py()))
    out = []
    for n in order:
        lang = got["lang"][n].as_py()
        parts = [(np.array(b.values, np.int32), np.array(c.values, np.float32), lang) for b, c in zip(got["buckets"][n], got["counts"][n], strict=True)]
        out.append((parts[0], parts[1:]))
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected; only the text is read.

    Null texts and texts without a letter are `und`, 0.0, rejected. Null and repeated ids pass through; other
    columns are ignored; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns as they are, whose language isn't rejected."""
    prepare(docs.sparkSession)
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not m.predict(t.as_py())[2] for t in batch.column(where)], pa.bool_()))
        settle()

    return docs.mapInArrow(run, docs.schema)


def train_on(docs: DataFrame, folds: int = 3, held: int = 1) -> LanguageModel:
    """A model from the rows of documents with a language whose crc32 of the id, modulo folds, isn't `held`."""
    prepare(docs.sparkSession)
    model = train(labelled_sample(docs, bucket_of_id("doc_id", folds) != held))
    settle_driver(docs.sparkSession)
    return model
