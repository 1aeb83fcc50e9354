"""Chroma audio fingerprints of media columns, and their alignment.

A recording (16-bit mono PCM in a binary column) becomes frames of energy in the 12 pitch classes. Over an
integral image of the frames, 16 fixed rectangle filters compare neighbouring areas of time and pitch; each
filter's log ratio is quantised to 2 bits in Gray code, and the 16 pairs are packed into one 32-bit integer
for each position. Two recordings are aligned by the histogram of offsets at which they have equal pairs of successive
integers (single integers agree by chance, and such votes would grow with the square of a collection); at the offset with
most votes, the share of differing bits over the whole overlap says how alike they are.

A recording matches a query if at least MIN_VOTES pairs are equal at the best offset and at most MAX_ERROR of the
overlap's bits differ. Votes come from an inverted index: runs of one pair (value, recording, position, length)
of recordings and clips meet by value, in an equi-join whose skewed values Spark splits, and no frequent pair is
left out. Two runs vote for a trapezoid of offsets, given by the four places where its slope changes, so a
long note or silence against another is four rows, not a square; the slopes' running sums are the histogram.
Recordings with equal fingerprints are one class, named by its smallest id, and so are clips; every match counts, as a
row between two classes, so groups of copies don't multiply.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, stored

RATE, FRAME, HOP, SPAN = 4000, 512, 128, 12
LOW_HZ, HIGH_HZ = 60.0, 1900.0
MIN_VOTES, MAX_ERROR = 3, 0.25
#: Frames transformed at once.
FRAMES = 4096


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, height, width of the 16 filters, by rule: every kind at several heights and widths."""
    return [(k % 6, (5 * k) % 7, 2 + k % 5 if k % 6 != 1 else 4, (4, 8, SPAN)[k % 3]) for k in range(16)]


FILTERS = _filters()
#: Bounds of the four levels of a filter's log ratio, and their 2-bit Gray codes.
LEVELS, GRAY = np.array([-0.25, 0.0, 0.25]), np.array([0, 1, 3, 2], np.uint32)


def _pitch_map() -> np.ndarray:
    """Which pitch class each spectral bin adds to, as a bins x 12 matrix."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    table = np.zeros((len(hz), 12), np.float32)
    for k, f in enumerate(hz):
        if LOW_HZ <= f <= HIGH_HZ:
            table[k, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return table


_MAP, _HANN = _pitch_map(), np.hanning(FRAME).astype(np.float32)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, each frame at unit sum; silent frames are even."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12), np.float32)
    views = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    power = lambda frames: np.abs(np.fft.rfft(frames * _HANN, axis=1)) ** 2
    energy = np.concatenate([power(views[at : at + FRAMES]).astype(np.float32) @ _MAP for at in range(0, len(views), FRAMES)])
    total = energy.sum(1, keepdims=True)
    return np.where(total > 1e-6, energy / np.maximum(total, 1e-6), 1 / 12).astype(np.float32)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """The packed integers, one for each position with SPAN frames from it on."""
    image = chroma(pcm)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums = np.zeros((len(image) + 1, 13), np.float64)
    sums[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)
    t = np.arange(n)

    def area(x0, x1, y0, y1):
        return sums[t + x1, y1] - sums[t + x0, y1] - sums[t + x1, y0] + sums[t + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        h = min(h, 12 - y)
        half_w, half_h = w // 2, max(1, h // 2)
        whole = area(0, w, y, y + h)
        if kind == 0:  # the area against all pitches
            a, b = whole, area(0, w, 0, 12) * (h / 12)
        elif kind == 1:  # low against high pitches
            a, b = area(0, w, y, y + half_h), area(0, w, y + half_h, y + h)
        elif kind == 2:  # before against after
            a, b = area(0, half_w, y, y + h), area(half_w, w, y, y + h)
        elif kind == 3:  # diagonals
            a = area(0, half_w, y, y + half_h) + area(half_w, w, y + half_h, y + h)
            b = whole - a
        elif kind == 4:  # the middle third of the time against the rest
            a = area(w // 3, w - w // 3, y, y + h)
            b = (whole - a) / 2
        else:  # the middle pitches against the rest
            third = max(1, h // 3)
            a = area(0, w, y + third, y + h - third) if h > 2 * third else area(0, w, y, y + third)
            b = whole - a
        ratio = np.log((1e-3 + np.maximum(a, 0)) / (1e-3 + np.maximum(b, 0)))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(LEVELS, ratio)]
    return out


def bit_errors(query: np.ndarray, other: np.ndarray, offset: int) -> float:
    """Share of differing bits where the two overlap at the offset."""
    a, b = query[max(0, -offset) :], other[max(0, offset) :]
    n = min(len(a), len(b))
    return float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n)


def _samples(media: bytes | None) -> np.ndarray:
    return np.frombuffer(media[: len(media) // 2 * 2], "<i2").astype(np.float32) / 32768 if media else np.zeros(0, np.float32)


def fingerprints(media: DataFrame, id_col: str = "media_id", audio_col: str = "audio") -> DataFrame:
    """One row per input row: media_id, codes (array<long>), fp_sha256 of the little-endian integers.

    Null, empty and too short recordings have no codes. Null and repeated ids pass through; other columns are
    ignored; an empty table gives an empty table.
    """
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(_samples(a.as_py())) for a in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype(np.int64) for p in prints], pa.list_(pa.int64())), pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in prints])], ["media_id", "codes", "fp_sha256"])

    return media.select(media[id_col].cast("long").alias("media_id"), media[audio_col].cast("binary").alias("audio")).mapInArrow(run, "media_id long, codes array<long>, fp_sha256 string")


def _runs(classes: DataFrame, name: str) -> DataFrame:
    """value, name, start, length of each run of one pair of successive integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = codes.values.to_numpy().astype(np.uint64)
                values = ((codes[:-1] << np.uint64(32)) | codes[1:]).view(np.int64)
                if not len(values):
                    continue
                starts = np.concatenate([[0], np.nonzero(values[1:] != values[:-1])[0] + 1])
                lengths = np.diff(np.append(starts, len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(values[starts]), pa.array(np.full(len(starts), owner)), pa.array(starts.astype(np.int64)), pa.array(lengths.astype(np.int64))], ["value", name, "start", "length"])

    return classes.select(name, "codes").mapInArrow(run, f"value long, {name} long, start long, length long")


def _offsets(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """clip_class, class_id, offset, votes of the offsets with most votes, MIN_VOTES or more; of a plateau its two ends."""
    a = _runs(queries, "clip_class").withColumnsRenamed({"start": "s1", "length": "l1"})
    b = _runs(entries, "class_id").withColumnsRenamed({"start": "s2", "length": "l2"})
    at = F.col("s2") - F.col("s1") + 1
    turns = ((at - F.col("l1"), 1), (at, -1), (at + F.col("l2") - F.col("l1"), -1), (at + F.col("l2"), 1))
    events = a.join(b, "value").select("clip_class", "class_id", F.explode(F.array(*(F.struct(o.alias("offset"), F.lit(d).alias("turn")) for o, d in turns))).alias("e"))
    slopes = events.groupBy("clip_class", "class_id", "e.offset").agg(F.sum("e.turn").alias("turn")).filter("turn <> 0")
    pair = Window.partitionBy("clip_class", "class_id").orderBy("offset")
    so_far = pair.rowsBetween(Window.unboundedPreceding, 0)
    lines = slopes.withColumns({"slope": F.sum("turn").over(so_far), "until": F.lead("offset").over(pair) - 1})
    # a stretch begins one step up its slope from where the last one ended
    lines = lines.withColumn("rise", F.col("slope") * (F.coalesce("until", "offset") - F.col("offset") + 1))
    lines = lines.withColumn("end", F.sum("rise").over(so_far))
    ends = lines.select("clip_class", "class_id", F.explode(F.array(F.struct("offset", (F.col("end") - F.col("rise") + F.col("slope")).alias("votes")), F.struct(F.coalesce("until", "offset").alias("offset"), F.col("end").alias("votes")))).alias("v")).select("clip_class", "class_id", "v.*").filter(F.col("votes") >= MIN_VOTES)
    most = Window.partitionBy("clip_class", "class_id").orderBy(F.desc("votes"))
    return ends.distinct().withColumn("n", F.rank().over(most)).filter("n = 1").drop("n")


def _matches(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """clip_class, class_id, offset, votes, error of every match; of offsets with equal votes the one with fewer errors, then the nearer, then the smaller."""
    rows = _offsets(entries, queries).join(queries.select("clip_class", F.col("codes").alias("q")), "clip_class").join(entries.select("class_id", F.col("codes").alias("e")), "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = [bit_errors(q.values.to_numpy().astype(np.uint32), e.values.to_numpy().astype(np.uint32), o) for o, q, e in zip(batch.column(2).to_pylist(), batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(error, pa.float64())], ["clip_class", "class_id", "offset", "votes", "error"])

    found = rows.select("clip_class", "class_id", "offset", "votes", "q", "e").mapInArrow(run, "clip_class long, class_id long, offset long, votes long, error double")
    best = found.groupBy("clip_class", "class_id").agg(F.min(F.struct("error", F.abs("offset").alias("far"), "offset", "votes")).alias("b"))
    return best.select("clip_class", "class_id", F.col("b.offset").cast("int").alias("offset"), F.col("b.votes").cast("int").alias("votes"), "b.error").filter(F.col("error") <= MAX_ERROR)


def _classes(prints: DataFrame, name: str) -> DataFrame:
    """fp_sha256, the smallest id with it and the codes, of the rows with an id and codes."""
    some = prints.filter((F.size("codes") > 0) & F.col("media_id").isNotNull())
    return stored(some.groupBy("fp_sha256").agg(F.min("media_id").alias(name), F.min("codes").alias("codes")))


def _aligned(prints: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The recordings, one clip an id, the recordings' classes, and every match between classes; all computed once."""
    prepare(prints.sparkSession)
    prints = stored(prints.select("media_id", "codes", "fp_sha256"))
    asked = clips.filter(F.col("media_id").isNotNull()).groupBy("media_id").agg(F.min(F.struct("fp_sha256", "codes")).alias("c"))
    asked = stored(asked.select("media_id", "c.fp_sha256", "c.codes"))
    entries, queries = _classes(prints, "class_id"), _classes(asked, "clip_class")
    return prints, asked.join(queries.select("fp_sha256", "clip_class"), "fp_sha256", "left"), entries.select("fp_sha256", "class_id"), stored(_matches(entries, queries), "matches")


def match_classes(prints: DataFrame, clips: DataFrame) -> DataFrame:
    """Every match, and who is in which class, as rows of three kinds; nothing is ranked or left out.

    `recording` rows, one per row of prints, and `clip` rows, one per id of clips: media_id, n_codes, fp_sha256
    and its class, class_id for recordings and clip_class for clips (the smallest id with the same fingerprint;
    null without an id or codes). `match` rows: clip_class, class_id, offset, votes and bit_error_rate; each clip of
    the one class matches each recording of the other. Equal recordings are listed each; of several clips of an
    id the one with the smallest digest counts.
    """
    prints, asked, classes, found = _aligned(prints, clips)
    none = lambda kind: F.lit(None).cast(kind)
    empty = [none("int").alias("offset"), none("int").alias("votes"), none("double").alias("bit_error_rate")]
    n = F.size("codes").cast("long").alias("n_codes")
    known = F.when(F.col("media_id").isNotNull(), F.col("class_id")).alias("class_id")
    recordings = prints.join(classes, "fp_sha256", "left").select(F.lit("recording").alias("kind"), "media_id", n, "fp_sha256", known, none("long").alias("clip_class"), *empty)
    sought = asked.select(F.lit("clip").alias("kind"), "media_id", n, "fp_sha256", none("long").alias("class_id"), "clip_class", *empty)
    matches = found.select(F.lit("match").alias("kind"), none("long").alias("media_id"), none("long").alias("n_codes"), none("string").alias("fp_sha256"), "class_id", "clip_class", "offset", "votes", F.round("error", 6).alias("bit_error_rate"))
    return recordings.unionByName(sought).unionByName(matches)


def match_recordings(prints: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per recording: media_id, n_codes, fp_sha256, class_id (smallest id with the same fingerprint), matches.

    prints are the recordings searched, clips the fingerprints to search for, named by the media_id of their row.
    matches, null for rows without a clip, are all recordings that match, by bit error rate and id:
    array<struct<media_id, offset, votes, bit_error_rate>>. Recordings and clips without codes match nothing.
    Rows with a null id are listed without a class; equal rows are listed each; of several clips of an id the
    one with the smallest digest counts. The arrays name every copy: for tables with large groups of copies
    match_classes has the same matches in fewer rows.
    """
    prints, asked, classes, found = _aligned(prints, clips)
    members = prints.filter(F.col("media_id").isNotNull()).join(classes, "fp_sha256").select("class_id", F.col("media_id").alias("match_id")).distinct()
    match = F.struct("error", F.col("match_id").alias("media_id"), "offset", "votes")
    lists = found.join(members, "class_id").groupBy("clip_class").agg(F.sort_array(F.collect_list(match)).alias("m"))
    matches = F.transform("m", lambda x: F.struct(x["media_id"].alias("media_id"), x["offset"].alias("offset"), x["votes"].alias("votes"), F.round(x["error"], 6).alias("bit_error_rate")))
    answers = asked.join(lists, "clip_class", "left").select("media_id", F.coalesce(matches, F.array().cast("array<struct<media_id: bigint, offset: int, votes: int, bit_error_rate: double>>")).alias("matches"))
    rows = prints.join(classes, "fp_sha256", "left").join(answers, "media_id", "left")
    return rows.select("media_id", F.size("codes").cast("long").alias("n_codes"), "fp_sha256", F.when(F.col("media_id").isNotNull(), F.col("class_id")).alias("class_id"), "matches")


def render_tones(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", skip: int = 0, noise: float = 0.0) -> DataFrame:
    """A media table for tables that have no audio: each vector component becomes a short tone, its value the pitch.

    Returns media_id and audio (16-bit mono PCM at RATE); a null vector has null audio, null components are
    silent. With skip and noise it is a worse copy: without its first samples, under noise seeded by the id.
    """
    prepare(vectors.sparkSession)
    phase = np.arange(HOP, dtype=np.float32) / RATE

    def render(name, vector) -> bytes | None:
        if vector is None:
            return None
        v = np.array([np.nan if x is None else x for x in vector], np.float64)
        hz = 220.0 * 2.0 ** (np.clip(np.round(np.nan_to_num(v) * 48), -18, 24) / 12)
        wave = (np.sin(2 * np.pi * hz[:, None] * phase) * np.where(np.isnan(v), 0, 0.6)[:, None]).reshape(-1)[skip:]
        if noise:
            wave = wave + np.random.default_rng(abs(name or 0)).normal(0, noise, len(wave))
        return (np.clip(wave, -1, 1) * 32767).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audio = [render(i.as_py(), v.as_py()) for i, v in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audio, pa.binary())], ["media_id", "audio"])

    return vectors.select(vectors[id_col].cast("long").alias("media_id"), vectors[vector_col].cast("array<float>").alias("v")).mapInArrow(run, "media_id long, audio binary")
