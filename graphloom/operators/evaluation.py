"""Answer metrics per row, and their means by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X


def exact_match(pred: Column, gold: Column) -> Column:
    return (X.normalize_answer(pred) == X.normalize_answer(gold)).cast("double")


def substring_match(pred: Column, gold: Column) -> Column:
    """One normalised answer contains the other; an empty prediction is contained in anything."""
    p, g = X.normalize_answer(pred), X.normalize_answer(gold)
    return (F.contains(g, p) | F.contains(p, g)).cast("double")


def multiset_intersection(a: Column, b: Column) -> Column:
    """Size of the intersection of two token bags."""
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def _prf(same: Column, n_pred: Column, n_gold: Column, otherwise: Column) -> Column:
    """struct<precision, recall, f1> from counts, `otherwise` for all three where no token is shared."""
    precision, recall = same / n_pred, same / n_gold
    f1 = 2 * precision * recall / (precision + recall)
    return F.struct(*(F.when(same > 0, v).otherwise(otherwise).alias(n) for n, v in (("precision", precision), ("recall", recall), ("f1", f1))))


def _bags(pred: Column, gold: Column, use) -> Column:
    """use(prediction tokens, gold tokens, shared tokens), the tokens made once a row."""

    def counted(r):
        return X.bind(lambda x: use(r["p"], r["g"], x["same"]), same=multiset_intersection(r["p"], r["g"]))

    return X.bind(counted, p=X.answer_tokens(pred), g=X.answer_tokens(gold))


def precision_recall_f1(pred: Column, gold: Column) -> Column:
    """struct<precision, recall, f1> over answer tokens; all 0 without a shared token."""
    return _bags(pred, gold, lambda p, g, same: _prf(same, F.size(p), F.size(g), F.lit(0.0)))


def _first_number(x: Column) -> Column:
    n = F.regexp_extract(x, "([-+]?[0-9]*\\.?[0-9]+)", 1)
    return F.when(n != "", n.cast("double"))


def f1_with_fallbacks(pred: Column, gold: Column) -> Column:
    """As precision_recall_f1, but both empty is 1, one empty 0; without a shared token containment is 0.6 and first numbers within 1 % are 1."""
    a, b = _first_number(pred), _first_number(gold)
    close = F.coalesce(F.abs(a - b) <= F.greatest(F.lit(1e-6), 0.01 * F.greatest(F.abs(b), F.lit(1.0))), F.lit(False))
    other = F.when(substring_match(pred, gold) == 1, 0.6).when(close, 1.0).otherwise(0.0)

    def scored(p, g, same):
        np_, ng = F.size(p), F.size(g)
        return _prf(same, np_, ng, F.when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0), 0.0).otherwise(other))

    return _bags(pred, gold, scored)


def evidence_recall_at(evidence: Column, gold: Column, k: int = 5) -> Column:
    """1 if the normalised gold answer is in one of the first k evidence texts."""

    def found(r):
        hit = F.exists(F.slice(r["evidence"], 1, k), lambda e: F.contains(X.normalize_answer(e), r["g"]))
        return F.coalesce(((r["g"] != "") & hit).cast("double"), F.lit(0.0))

    return X.bind(found, g=X.normalize_answer(gold), evidence=evidence)


def reasoning_depth(first: Column, second: Column) -> Column:
    """Distinct ids over two lists."""
    return F.size(F.array_union(first, second))


def metric_bundle(pred: Column, gold: Column, evidence: Column | None = None, k: int = 5) -> Column:
    """All metrics of one answer; an unanswered row scores 0 on each."""
    prf = f1_with_fallbacks(pred, gold)
    unanswered = F.coalesce(pred, F.lit("")) == L.NO_ANSWER
    zero = lambda c: F.when(unanswered, 0.0).otherwise(c)
    return F.struct(
        zero(exact_match(pred, gold)).alias("exact_match"),
        *(zero(prf[m]).alias(m) for m in ("precision", "recall", "f1")),
        zero(substring_match(pred, gold)).alias("substring_match"),
        zero(evidence_recall_at(evidence, gold, k) if evidence is not None else F.lit(0.0)).alias(f"evidence_recall_at_{k}"),
    )


def best_of(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Of several gold answers the best value of each metric."""
    return rows.groupBy(*keys).agg(*(F.max(m).alias(m) for m in metrics))


def mean4(x: Column) -> Column:
    """Mean without nulls to four places, 0 if there is none."""
    return F.coalesce(F.round(F.avg(x), 4), F.lit(0.0))


def answered(pred: Column) -> Column:
    return ~F.coalesce(pred, F.lit("")).isin("", "ERROR", L.NO_ANSWER)


def metrics_by_group(rows: DataFrame, level: str, kind: str, metrics: list[str]) -> DataFrame:
    """Means and counts by level, by type, by both and over all, in one pass of grouping sets."""
    view = rows.select(F.col(level).alias("level"), F.col(kind).alias("type"), *metrics)
    aggregates = [F.count(F.lit(1)).alias("questions"), *(mean4(F.col(m)).alias(m) for m in metrics)]
    return view.groupingSets([["level"], ["type"], ["level", "type"], []], "level", "type").agg(F.grouping_id("level", "type").cast("int").alias("grouping"), *aggregates)


def level_type_counts(rows: DataFrame, level: str, kind: str, types: list[str], pred: str) -> DataFrame:
    """Questions and answered questions of each level, and questions of each type."""
    counts = [F.count_if(F.col(kind) == t).alias(t) for t in types]
    return rows.groupBy(level).agg(F.count(F.lit(1)).alias("questions"), F.count_if(answered(F.col(pred))).alias("answered"), *counts)


def answer_summary(rows: DataFrame, pred: str, confidence: str) -> DataFrame:
    """One row: totals, answer rate and confidence buckets at 0.70 and 0.45."""
    ok = answered(F.col(pred))
    c = F.col(confidence)
    return rows.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(ok).alias("answered"),
        F.count_if(~ok).alias("unanswered"),
        F.coalesce(F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 1), F.lit(0.0)).alias("answer_rate_pct"),
        F.count_if(c >= 0.70).alias("high"),
        F.count_if((c < 0.70) & (c >= 0.45)).alias("medium"),
        F.count_if(c < 0.45).alias("low"),
    )


def graph_size_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each graph size."""
    return rows.agg(*(F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(f"avg_{c}") for c in columns))


def minmax(x: Column, window) -> Column:
    """Scaled to [0, 1] within the window; 0 where all values are equal."""
    low, high = F.min(x).over(window), F.max(x).over(window)
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def scaled(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] over the rows of a key, 0 where all are equal; bounds by an aggregate, so no task meets all rows of a key."""
    bounds = rows.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("_low", F.min), ("_high", F.max))))
    out = rows.join(bounds, keys)
    low, high = (lambda c: F.col(f"_low_{c}")), (lambda c: F.col(f"_high_{c}"))
    out = out.withColumns({c: F.when(high(c) > low(c), (F.col(c) - low(c)) / (high(c) - low(c))).otherwise(0.0) for c in columns})
    return out.select(*rows.columns)


def rrf(rows: DataFrame, keys: list[str], item: str, rank: str) -> DataFrame:
    """Reciprocal rank fusion over lists: sum of 1 / (rank + 1), ranks from 0."""
    return rows.groupBy(*keys, item).agg(F.sum(F.lit(1.0).cast("double") / (F.col(rank) + 1)).alias("rrf"))


def top_per(rows: DataFrame, keys: list[str], score: str, order: str, k: int) -> DataFrame:
    """The k best rows of each key by score, ties by the smaller `order`; Spark prunes to k a partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(order))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_of(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
