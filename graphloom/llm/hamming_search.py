"""Exact top-k search over 64-bit binary codes by incremental multi-index hashing.

A code is cut into SEGMENTS segments; the index is a table of every entry under each of its segment values. For a
query, radius 0, 1, 2, ... in every segment at once: codes whose segment differs from the query's in exactly that
many bits are looked up and verified by their full Hamming distance. A code within SEGMENTS * (radius + 1) - 1 bits
differs by at most `radius` bits in some segment, so once k verified ids lie within that bound, the answer, ties
included, is proven complete and that query is asked no further.

The index is dealt by segment and high bits of the value into buckets of about ENTRY_BLOCK entries; a bucket with more is
split by code. In a round each unproven query goes to the buckets that hold a value at the round's radius from one of its
segments, at most one row a bucket, and is looked up there: the bucket's codes are sorted by value, those at the
radius are verified, and the k best go on. A code is taken in its nearest segment only, so it is verified once. Equal
codes are one entry with its k smallest ids, as no further id of it can be in an answer in that order, and equal query
codes are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, prepare, stored

SEGMENTS, WIDTH = 4, 16
#: Entries and queries that meet in one task.
ENTRY_BLOCK, QUERY_BLOCK = 1 << 18, 1 << 21
_VALUES = np.arange(1 << WIDTH, dtype=np.int64)
_ONES = np.bitwise_count(_VALUES)


def sign_code(vector: str) -> Column:
    """A 64-bit code of the signs of a vector's first 64 components; a null component counts as not positive."""
    return F.expr(f"aggregate(transform(slice({vector}, 1, 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


def segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _sent(queries: DataFrame, radius: int, bits: int) -> DataFrame:
    """query, segment, bucket: the buckets, by the `bits` high bits of a value, that have values at the radius from each query's segments."""
    masks = _VALUES[_ONES == radius]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for code in batch.column(0).to_numpy():
                for s in range(SEGMENTS):
                    buckets = np.unique((((int(code) >> (WIDTH * s)) & ((1 << WIDTH) - 1)) ^ masks) >> (WIDTH - bits))
                    for column, values in zip(out, (np.full(len(buckets), code), np.full(len(buckets), s), buckets), strict=True):
                        column.append(values)
            if out[0]:
                query, segment_, bucket = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(segment_.astype(np.int32)), pa.array(bucket.astype(np.int32))], ["query", "segment", "bucket"])

    return queries.mapInArrow(run, "query long, segment int, bucket int")


def _look_up(radius: int, k: int):
    """A function over one bucket's entries and the queries sent to it: the k best of those at the radius in this, their nearest, segment."""
    masks = _VALUES[_ONES == radius]

    def run(key: tuple, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out, s = [], int(key[0])
        if len(entries) and len(queries):
            entries = entries.sort_values(["value", "code"])
            values, codes, n, low = (entries[c].to_numpy() for c in ("value", "code", "n", "low"))
            shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH)
            for query in queries["query"].to_numpy():
                keys = ((int(query) >> (WIDTH * s)) & ((1 << WIDTH) - 1)) ^ masks
                starts, ends = np.searchsorted(values, keys, "left"), np.searchsorted(values, keys, "right")
                some = ends > starts
                sizes = (ends - starts)[some]
                if not len(sizes):
                    continue
                at = np.repeat(starts[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                apart = (codes[at] ^ query).view(np.uint64)
                each = np.bitwise_count((apart[:, None] >> shifts) & np.uint64((1 << WIDTH) - 1))
                own = (each[:, :s] > radius).all(1) & (each[:, s:] >= radius).all(1)  # in no segment nearer, and in this one first
                at, distance = at[own], each[own].sum(1, dtype=np.int32)
                best = np.lexsort((low[at], distance))[:k]
                out.append(pd.DataFrame({"query": query, "code": codes[at[best]], "n": n[at[best]], "low": low[at[best]], "distance": distance[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "code": [], "n": [], "low": [], "distance": []}).astype({"query": "int64", "code": "int64", "n": "int32", "low": "int64", "distance": "int32"})

    return run


def search(entries: DataFrame, queries: DataFrame, k: int = 10, entry_block: int = ENTRY_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest entries of each query: query_id, rank (from 1), neighbor_id, distance.

    Both inputs have id and code (long). Order is by Hamming distance, then id; entries include the query's own
    row where it is one. Rows with a null id or code are neither entries nor answered; a query id given more
    than once with one code is answered once, with several codes once for each; with fewer than k entries all are
    returned; an empty input gives an empty table. Further columns are ignored.
    """
    prepare(entries.sparkSession)
    rows = entries.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).dropna().distinct()
    first = Window.partitionBy("code").orderBy("id")
    grouped = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k ids a code at most
    grouped = stored(grouped, "codes")
    asked = stored(queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("code")).dropna().distinct(), "asked")
    need = min(k, grouped.agg(F.sum(F.size("ids"))).first()[0] or 0)
    entry = grouped.select("code", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("low"))
    total = grouped.count()
    bits = min(WIDTH, max(0, (-(-total // entry_block) - 1).bit_length()))
    spread = entry.select("code", "n", "low", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)))).alias("s")).select("code", "n", "low", "s.*", F.shiftright("s.value", WIDTH - bits).alias("bucket"))
    sizes = spread.groupBy("segment", "bucket").agg(F.ceil(F.count(F.lit(1)) / entry_block).alias("parts"))  # SEGMENTS * 2 ** bits rows
    sizes = stored(sizes, "sizes")
    index = stored(spread.join(sizes, ["segment", "bucket"]).withColumn("part", F.pmod(F.xxhash64("code"), "parts")).drop("parts"), "index")
    active = stored(asked.select(F.col("code").alias("query")).distinct(), "active")
    best = stored(active.select("query", F.lit(0).cast("long").alias("code"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("low"), F.lit(0).alias("distance")).limit(0), "best")
    ranked = Window.partitionBy("query").orderBy("distance", "low")
    for radius in range(WIDTH + 1 if need else 0):
        blocks = max(1, -(-active.count() // query_block))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
        left = index.select("segment", "bucket", "part", "value", "code", "n", "low", every)
        sent = _sent(active, radius, bits).join(sizes, ["segment", "bucket"])
        right = sent.select("segment", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "query", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
        keys = ["segment", "bucket", "part", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_look_up(radius, k), "query long, code long, n int, low long, distance int")
        better = stored(best.unionByName(found).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank"), "best")
        proven = better.filter(F.col("distance") <= SEGMENTS * (radius + 1) - 1).groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") >= need)
        left = stored(active.join(proven.hint("merge"), "query", "left_anti"), "active")
        discard(best, active)
        best, active = better, left
        if active.isEmpty():
            break
    discard(index, sizes, active)
    ids = best.select("query", "code", "distance").join(grouped, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    answers = ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(answers, asked["code"] == answers["query"]).select("query_id", "rank", "neighbor_id", "distance")


def oracle_sql(k: int = 10, every: int = 20) -> str:
    """DuckDB SQL for the search of every `every`-th embedding among all by sign codes."""
    return f"""with c as (select vec_id id, list_transform(embedding[1:64], lambda x: x > 0) bits from embeddings where vec_id is not null and embedding is not null),
d as (select q.id query_id, e.id neighbor_id, len(list_filter(list_zip(q.bits, e.bits), lambda p: p[1] <> p[2]))::int distance from c q, c e where q.id % {every} = 0)
select query_id, rank::int rank, neighbor_id, distance from (select *, row_number() over (partition by query_id order by distance, neighbor_id) rank from d) where rank <= {k}"""
