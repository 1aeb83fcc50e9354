"""Mixing sources to target weights: iterative proportional fitting over token counts, then calibrated sampling.

Documents are counted into cells of source, language and topic. The cells' token weights are raked: each margin in
turn is scaled to its targets, and no cell's weight may pass its tokens (a weight above them is cut to them, and the
other cells of its margins take the rest in the next rounds), until no scaling differs from 1 by more than TOLERANCE.
A cell's probability is its weight for each token, so the expected sample has the target shares. The budget starts at
a share, BUDGET, of the largest one at which no margin value needs more tokens than it has; where the margins together
need more than their cells have, every SHRINK rounds it is lowered by what the worst value lacks, and to SPARE of that, to LEAST of its start
at least. Targets that contradict each other whatever the budget can't be reached by any weights: the raking then ends
after ROUNDS rounds, and `margins` states for each value what was asked for and what is reached. A document is taken if
a hash of its id, uniform on [0, 1), is below its cell's probability, so results don't depend on partitioning and
repeat on lost executors.

Topics are a column of the documents, where they have one. Otherwise each is named by a word: TOPICS words of five
letters or more, those in most documents of the words in at most a tenth of them; a document's topic is the one of
these words that it has most often.

DataFrame functions only. Margins are summed by aggregates and joined back, so no task meets all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, settle_driver, stored

MARGINS = ("source", "lang", "topic")
#: Target share of a margin's value: its token share to this power, over their sum (1 keeps the shares, 0 makes them equal).
POWERS = {"source": 0.5, "lang": 0.9, "topic": 0.9}
BUDGET, TOLERANCE, ROUNDS, SEED, NONE = 0.95, 1e-3, 40, "mix", "(none)"
SHRINK, SPARE, LEAST = 4, 0.95, 0.1
TOPICS, COMMON = 8, 10
BROADCAST_CELLS = 20_000
WORDS, LONG_WORDS = "[^\\x20\\x09-\\x0D]+", "\\p{L}{5,}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(LONG_WORDS), F.lit(0))


def topic_words(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> list[str]:
    """At most `topics` words, those of most documents among the words of at most one in COMMON documents; ties by the word."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct(long_words(docs[text_col].cast("string")))).alias("w"))
    best = words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") * COMMON <= n).orderBy(F.desc("df"), "w").limit(topics)
    return [r["w"] for r in best.collect()]  # bounded: `topics` words


def topic_of(text: Column, words: list[str]) -> Column:
    """The word of the list that the text has most often, the earlier in a tie; `other` without any, `empty` for null and empty texts."""
    if not words:
        return F.when(text.isNull() | (F.length(text) == 0), "empty").otherwise("other")
    found = F.array(F.struct(F.filter(long_words(text), lambda w: w.isin(words)).alias("f")))  # one element: computed once
    votes = lambda f: F.transform(F.array(*map(F.lit, words)), lambda w, k: F.struct(F.size(F.filter(f, lambda x: x == w)).alias("n"), (-k).alias("k"), w.alias("w")))
    best = F.get(F.transform(found, lambda r: F.when(F.size(r["f"]) == 0, "other").otherwise(F.array_max(votes(r["f"]))["w"])), F.lit(0))
    return F.when(text.isNull() | (F.length(text) == 0), "empty").otherwise(best)


def _cell_columns(docs: DataFrame, text_col: str, topic_col: str | None) -> dict[str, Column]:
    text = docs[text_col].cast("string")
    whole = lambda c: F.coalesce(docs[c].cast("string"), F.lit(NONE))
    topic = whole(topic_col) if topic_col else topic_of(text, topic_words(docs, text_col))
    return {"source": whole("source"), "lang": whole("lang"), "topic": topic}


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _draw(doc_id: Column) -> Column:
    """Uniform on [0, 1) by the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixture(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, tokens, prob and sampled.

    targets gives weights to the values of a margin, in place of its power; values that it doesn't list get none.
    Null source, language or topic column is the value `(none)`; null or empty texts have 0 tokens, the topic
    `empty` where topics are read off texts, and cells without tokens probability 1, as they cost nothing. Null ids
    hash as the empty text, repeated ids of one cell are taken or left together; other columns are ignored; an
    empty table gives an empty table.
    """
    cell = _cell_columns(docs, text_col, topic_col)
    base = stored(docs.select(docs[id_col].cast("long").alias("doc_id"), *(c.alias(m) for m, c in cell.items()), _tokens(docs[text_col].cast("string")).alias("tokens")), "mixture")
    cells = cell_probabilities(base, powers, budget, targets)
    few = cells.count() <= BROADCAST_CELLS
    joined = base.join(F.broadcast(cells) if few else cells, list(MARGINS))
    return joined.select("doc_id", *MARGINS, "tokens", "prob", (_draw(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def _goals(cells: DataFrame, m: str, power: float, weights: dict[str, float] | None) -> DataFrame:
    """The margin's values, m, their tokens, have, and their target shares, goal; a stored table."""
    have = cells.groupBy(m).agg(F.sum("t").alias("have"))
    if weights is None:
        total = have.agg(F.sum("have")).first()[0] or 0.0
        raw = F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(total), F.lit(float(power)))).otherwise(0.0) if total else F.lit(0.0)
    else:
        known = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else None
        raw = F.when(F.col("have") > 0, F.coalesce(known[F.col(m)], F.lit(0.0))).otherwise(0.0) if weights else F.lit(0.0)
    have = stored(have.withColumn("raw", raw), "margin")
    of_all = have.agg(F.sum("raw")).first()[0] or 0.0
    return have.select(m, "have", (F.col("raw") / F.lit(of_all) if of_all else F.lit(0.0)).alias("goal"))


def cell_probabilities(base: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic, t (tokens), prob and the goals of the margins, of each cell of the counted documents; a stored table."""
    powers, targets = POWERS | (powers or {}), targets or {}
    cells = stored(base.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("t")), "cells")
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    settle_driver(base.sparkSession)
    goals = {m: _goals(cells, m, powers[m], targets.get(m)) for m in MARGINS}
    reach = [goals[m].filter("goal > 0").agg(F.min(F.col("have") / F.col("goal"))).first()[0] for m in MARGINS]
    size = budget * min([total, *(r for r in reach if r is not None)])
    for m in MARGINS:
        cells = cells.join(goals[m].select(m, F.col("goal").alias(f"goal_{m}")), m)
    share, least = size / total if total else 0.0, size * LEAST
    cells = stored(cells.select(*MARGINS, "t", (F.col("t") * share).alias("w"), *(f"goal_{m}" for m in MARGINS), F.lit(1.0).alias("err"), F.lit(1.0).alias("lack")), "raked")
    for n in range(1, ROUNDS + 1 if total else 1):
        step = cells.withColumns({"err": F.lit(0.0), "lack": F.lit(1.0)})
        for m in MARGINS:
            if m == "source":  # a source's cells are few, however many sources there are: no other margin's are
                step = step.withColumn("part", F.sum("w").over(Window.partitionBy(m)))
            else:
                step = step.join(step.groupBy(m).agg(F.sum("w").alias("part")), m)
            scale = F.when(F.col("part") > 0, F.col(f"goal_{m}") * F.lit(size) / F.col("part")).otherwise(1.0)
            scaled = {"w": F.least("t", F.col("w") * F.col("scale")), "err": F.greatest("err", F.abs(F.col("scale") - 1)), "lack": F.greatest("lack", "scale")}
            step = step.withColumn("scale", scale).withColumns(scaled).drop("scale", "part")
        step = stored(step.select(cells.columns), "raked")
        discard(cells)
        cells = step
        err, lack = cells.agg(F.max("err"), F.max("lack")).first()
        if err <= TOLERANCE:
            break
        if n % SHRINK == 0:
            settle_driver(base.sparkSession)  # each round leaves plans and broadcasts
            if lack > 1.01:
                size = max(least, size / lack * SPARE)
    return cells.select(*MARGINS, "t", F.when(F.col("t") > 0, F.least(F.lit(1.0), F.col("w") / F.col("t"))).otherwise(1.0).alias("prob"), *(f"goal_{m}" for m in MARGINS))


def margins(cells: DataFrame) -> DataFrame:
    """Of each value of each margin of cell_probabilities: margin, value, share of the tokens, target share, expected share of the sample."""
    expected = F.col("t") * F.col("prob")
    all_t, all_e = cells.agg(F.sum("t"), F.sum(expected)).first()
    out = []
    for m in MARGINS:
        rows = cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("t").alias("t"), F.first(f"goal_{m}").alias("target"), F.sum(expected).alias("e"))
        out.append(rows.select("margin", "value", (F.col("t") / F.lit(all_t)).alias("share"), "target", (F.col("e") / F.lit(all_e)).alias("expected")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def mix_documents(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, topic_col: str | None = None) -> DataFrame:
    """The input's rows, all columns as they are, that the mixture takes; rows are treated as in `mixture`."""
    cell = _cell_columns(docs, "text", topic_col)
    base = docs.select(*(c.alias(m) for m, c in cell.items()), _tokens(docs["text"].cast("string")).alias("tokens"))
    cells = cell_probabilities(base, powers, budget, targets)
    few = cells.count() <= BROADCAST_CELLS
    keyed = docs.select(*(docs[c].alias(f"in_{c}") for c in docs.columns), *(c.alias(m) for m, c in cell.items()))
    taken = keyed.join(F.broadcast(cells) if few else cells, list(MARGINS)).filter(_draw(F.col("in_doc_id")) < F.col("prob"))
    return taken.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def oracle_sql(powers: dict[str, float] | None = None, budget: float = BUDGET) -> str:
    """DuckDB SQL for mixture() over documents, prob rounded to 9 places: one recursion step a round."""
    powers = POWERS | (powers or {})
    cells, goals = ", ".join(MARGINS), ", ".join(f"goal_{m}" for m in MARGINS)
    words = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{LONG_WORDS}')"
    goal = ", ".join(f"(case when have_{m} > 0 then pow(have_{m} / total, {powers[m]}::double) else 0::double end) raw_{m}" for m in MARGINS)
    have = ", ".join(f"sum(t) over (partition by {m}) have_{m}, count(*) over (partition by {m}) n_{m}" for m in MARGINS)
    share = ", ".join(f"raw_{m} / sum(raw_{m} / n_{m}) over () goal_{m}" for m in MARGINS)
    reach = ", ".join(f"min(case when goal_{m} > 0 then have_{m} / goal_{m} end) over ()" for m in MARGINS)
    inner = f"select n, {cells}, t, w, {goals}, size, low from r where err > {TOLERANCE} and n < {ROUNDS} and size > 0"
    err = [f"abs(f_{m} - 1)" for m in MARGINS]
    lack = f"max(greatest(1, {', '.join(f'f_{m}' for m in MARGINS)})) over ()"
    for m in MARGINS:
        part = f"sum(w) over (partition by {m})"
        inner = f"select *, case when {part} > 0 then goal_{m} * size / {part} else 1 end f_{m} from ({inner})"
        inner = f"select * exclude (w), least(t, w * f_{m}) w from ({inner})"
    return f"""with recursive base0 as (select doc_id, coalesce(source, '{NONE}') source, coalesce(lang, '{NONE}') lang, text, {words} ws from documents),
tw as (select w, count(*) df from (select unnest(list_distinct(ws)) w from base0) group by w having count(*) * {COMMON} <= (select count(*) from documents) order by df desc, w limit {TOPICS}),
tl as (select coalesce(list(w order by df desc, w), []) l from tw),
base as materialized (select doc_id, source, lang, case when text is null or length(text) = 0 then 'empty' when not list_has_any(ws, l) then 'other'
  else list_sort(list_transform(l, lambda x, k: {{'n': -len(list_filter(ws, lambda y: y = x)), 'k': k, 'w': x}}))[1].w end topic,
  coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::bigint tokens from base0, tl),
c0 as (select {cells}, sum(tokens)::double t from base group by {cells}),
c1 as (select *, sum(t) over () total, {have} from c0),
c2 as (select *, {goal} from c1),
c3 as (select *, {share} from c2),
c4 as materialized (select *, {budget}::double * least(total, {reach}) size from c3),
r as (select 0 n, {cells}, t, t * (size / total) w, {goals}, size, size * {LEAST}::double low, 1::double err from c4
  union all select n + 1, {cells}, t, w, {goals}, case when (n + 1) % {SHRINK} = 0 and {lack} > 1.01 then greatest(low, size / {lack} * {SPARE}::double) else size end, low, max(greatest({", ".join(err)})) over () from ({inner})),
p as (select {cells}, case when t > 0 then least(1::double, w / t) else 1 end prob from r where n = (select max(n) from r))
select doc_id, {cells}, tokens, round(prob, 9) prob, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0::double < prob as sampled from base join p using ({cells})"""
