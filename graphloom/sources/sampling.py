"""Stratified question samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS, KINDS = ("easy", "medium", "hard"), ("bridge", "comparison")


def quotas(n: int, levels: tuple[str, ...] = LEVELS, kinds: tuple[str, str] = KINDS) -> dict[tuple[str, str], int]:
    """How many of each level and type: an equal share of each level, the first ones get the rest; half of a level, rounded down, the first type."""
    out = {}
    for k, level in enumerate(levels):
        share = n // len(levels) + (k < n % len(levels))
        out[level, kinds[0]] = share // 2
        out[level, kinds[1]] = share - share // 2
    return out


def stratified(rows: DataFrame, wanted: dict[tuple[str, str], int], order: Column, level: str = "level", kind: str = "type") -> DataFrame:
    """The first rows of each stratum by `order`, a portable key or a seeded hash; strata without a quota give none."""
    pairs = [x for (a, b), q in wanted.items() for x in (F.lit(f"{a}\x1f{b}"), F.lit(q))]
    quota = F.element_at(F.create_map(*pairs), F.concat_ws("\x1f", level, kind))
    w = Window.partitionBy(level, kind).orderBy(order)
    return rows.withColumn("quota", quota).filter("quota > 0").withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= F.col("quota")).drop("quota")


def sample_questions(rows: DataFrame, n: int, seed: int = 42, key: str = "q_id") -> DataFrame:
    """n questions over all levels and types by a seeded hash; all of them for n = 0."""
    return stratified(rows, quotas(n), F.xxhash64(F.col(key), F.lit(seed))).drop("pick") if n else rows


def sample_level(rows: DataFrame, level: str, n: int, seed: int = 42, key: str = "q_id") -> DataFrame:
    """n questions of one level."""
    picked = rows.filter(F.col("level") == level).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return picked.limit(n) if n else picked
