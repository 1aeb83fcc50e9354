"""Typed edge tables of the sentence, span and entity graphs.

Every family is an equi-join, a lead/lag window or a bounded explode; none compares all pairs of a corpus.
Families carry a priority, and one resolver keeps, for each ordered pair, the last writer's type and weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import lexicons as L
from graphloom.functions import text as X

W = L.EDGE_WEIGHTS
COLUMNS = ["doc_id", "src", "dst", "type", "weight", "entity", "prio"]


def _edges(rows: DataFrame, kind: Column | str, weight: Column | float, prio: int, entity: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    weight = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    entity = F.lit(None).cast("string") if entity is None else entity
    return rows.select("doc_id", "src", "dst", kind.alias("type"), weight.cast("double").alias("weight"), entity.alias("entity"), F.lit(prio).alias("prio"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, in one pass."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("ends")
    return edges.select(*(c for c in edges.columns if c not in ("src", "dst")), ends).select(*(F.col(f"ends.{c}") if c in ("src", "dst") else F.col(c) for c in edges.columns))


def resolve(edges: DataFrame) -> DataFrame:
    """One edge for each (doc_id, src, dst): type and weight of the highest priority; the last non-null entity survives."""
    last = F.max_by(F.struct("type", "weight"), F.struct("prio", "type")).alias("e")
    entity = F.max_by("entity", F.when(F.col("entity").isNotNull(), F.struct("prio", "entity"))).alias("entity")
    return edges.groupBy("doc_id", "src", "dst").agg(last, entity).select("doc_id", "src", "dst", "e.type", "e.weight", "entity")


def _pairs(nodes: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Ordered pairs a < b of nodes that share the keys."""
    a = nodes.select(*keys, F.col("node_id").alias("src"))
    b = nodes.select(*keys, F.col("node_id").alias("dst"))
    joined = a.join(b, keys).filter(F.col("src") < F.col("dst"))
    return joined.filter(where) if where is not None else joined


def structural_edges(sentences: DataFrame, context: bool = False) -> DataFrame:
    """Sentence edges both ways: same page, following sentence, same section, two or three sentences on; later families win."""
    node = sentences.select("doc_id", "node_id", "page", "section")
    order = Window.partitionBy("doc_id").orderBy("node_id")
    ahead = node.select("doc_id", F.col("node_id").alias("src"), *(F.lead("node_id", k).over(order).alias(f"n{k}") for k in (1, 2, 3)))
    steps = ahead.select("doc_id", "src", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"n{k}").alias("dst")) for k in (1, 2, 3)))).alias("s")).select("doc_id", "src", "s.*").filter("dst is not null")
    page = _edges(_pairs(node, ["doc_id", "page"]), "page", W["page"], 1)
    adjacent = _edges(steps.filter("step = 1"), "context" if context else "adjacent", W["context" if context else "adjacent"], 2)
    section = _edges(_pairs(node.filter(F.col("section") != "GLOBAL"), ["doc_id", "section"]), "section", W["section"], 3)
    near = _edges(steps.filter((F.col("dst") - F.col("src")).between(2, 3)), "proximity", 1.0 / (F.col("dst") - F.col("src")), 4)
    return both_ways(page.unionByName(adjacent).unionByName(section).unionByName(near))


def span_structural_edges(spans: DataFrame) -> DataFrame:
    """Spans of one sentence are linked both ways; else a span is followed by the next (sequential) and looks back (backward)."""
    s = spans.select("doc_id", "sentence_id", F.col("node_id"))
    same = both_ways(_edges(_pairs(s, ["doc_id", "sentence_id"]), "same_sentence", W["same_sentence"], 2))
    order = Window.partitionBy("doc_id").orderBy("node_id")
    step = s.select("doc_id", F.col("node_id").alias("src"), "sentence_id", F.lead("node_id").over(order).alias("dst"), F.lead("sentence_id").over(order).alias("next")).filter("dst is not null and next <> sentence_id")
    forward = _edges(step, "sequential", W["sequential"], 1)
    back = _edges(step.withColumns({"src": F.col("dst"), "dst": F.col("src")}), "backward", W["backward"], 1)
    return same.unionByName(forward).unionByName(back)


def similarities(nodes: DataFrame, vector: str = "embedding", block: list[str] | None = None) -> DataFrame:
    """Cosine of every pair a < b within a block (default: the document). Norms are computed once a node."""
    block = block or ["doc_id"]
    unit = nodes.select(*block, "node_id", F.col(vector).alias("v"), X.norm(F.col(vector)).alias("n"))
    a = unit.select(*block, F.col("node_id").alias("src"), F.col("v").alias("va"), F.col("n").alias("na"))
    b = unit.select(*block, F.col("node_id").alias("dst"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    size = F.col("na") * F.col("nb")
    sim = F.when(size > 0, X.dot(F.col("va"), F.col("vb")) / size).otherwise(0.0)
    return a.join(b, block).filter(F.col("src") < F.col("dst")).select(*block, "src", "dst", sim.alias("sim"))


def dynamic_threshold(sims: DataFrame, quantile: float, floor: float, block: list[str] | None = None) -> DataFrame:
    """Each block's threshold: the larger of the floor and the exact quantile of its pair similarities."""
    block = block or ["doc_id"]
    return sims.groupBy(*block).agg(F.greatest(F.lit(float(floor)), F.percentile("sim", F.lit(float(quantile)))).alias("threshold"))


def semantic_edges(sims: DataFrame, floor: float = 0.75, quantile: float = 0.85) -> DataFrame:
    """Pairs at or over the block's threshold, both ways; the weight is the similarity."""
    passing = sims.join(dynamic_threshold(sims, quantile, floor), "doc_id").filter(F.col("sim") >= F.col("threshold"))
    return both_ways(_edges(passing, "semantic", F.col("sim"), 5))


def knn_edges(sims: DataFrame, floor: float = 0.70, quantile: float = 0.80, neighbours: int = 3, existing: DataFrame | None = None) -> DataFrame:
    """For each node its `neighbours` most similar over the threshold, reversed ones added where absent; never over an existing edge."""
    passing = sims.join(dynamic_threshold(sims, quantile, floor), "doc_id").filter(F.col("sim") >= F.col("threshold")).select("doc_id", "src", "dst", "sim")
    directed = both_ways(passing)
    w = Window.partitionBy("doc_id", "src").orderBy(F.desc("sim"), "dst")
    nearest = directed.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= neighbours).drop("n")
    every = both_ways(nearest).dropDuplicates(["doc_id", "src", "dst"])
    if existing is not None:
        every = every.join(existing.select("doc_id", "src", "dst"), ["doc_id", "src", "dst"], "left_anti")
    return _edges(every, "semantic", F.col("sim"), 0)


def mention_pairs(mentions: DataFrame, kind: str, prio: int) -> DataFrame:
    """Both ways between nodes that mention an entity, by mention order; a repeated mention gives a self-loop.

    mentions: doc_id, entity, node_id, ord.
    """
    a = mentions.select("doc_id", "entity", F.col("node_id").alias("src"), F.col("ord").alias("oa"))
    b = mentions.select("doc_id", "entity", F.col("node_id").alias("dst"), F.col("ord").alias("ob"))
    pairs = a.join(b, ["doc_id", "entity"]).filter(F.col("oa") < F.col("ob")).select("doc_id", "src", "dst", "entity").distinct()
    return both_ways(_edges(pairs, kind, W[kind], prio, F.col("entity"))).distinct()


def entity_mentions(nodes: DataFrame, entities: str = "entities", shortest: int = 1) -> DataFrame:
    """doc_id, entity, node_id, ord for every element of the nodes' entity arrays."""
    rows = nodes.select("doc_id", "node_id", F.posexplode(entities).alias("pos", "entity")).filter(F.length("entity") >= shortest)
    return rows.select("doc_id", "entity", "node_id", F.struct("node_id", "pos").alias("ord"))


def discourse_edges(spans: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """From each marked span to every span at most one sentence away. The band join is an equi-join on three sentence ids."""
    marked = spans.select("doc_id", F.col("node_id").alias("src"), "sentence_id", X.discourse_types(F.col("text"), lexicon).alias("types")).filter(F.size("types") > 0)
    near = marked.select("doc_id", "src", "types", F.explode(F.sequence(F.col("sentence_id") - 1, F.col("sentence_id") + 1)).alias("sentence_id"))
    to = spans.select("doc_id", "sentence_id", F.col("node_id").alias("dst"))
    rows = near.join(to, ["doc_id", "sentence_id"]).filter(F.col("src") != F.col("dst"))
    return _edges(rows, F.element_at("types", -1), W["discourse"], 6)


def entity_node_edges(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entity nodes (doc_id, ent_id, text) and the mention edges span <-> entity, with text ids."""
    pairs = spans.select("doc_id", F.col("node_id").cast("string").alias("src"), F.explode("entities").alias("name")).filter(F.length("name") > 0).withColumn("dst", F.concat(F.lit("entity::"), "name")).distinct()
    nodes = pairs.select("doc_id", F.col("dst").alias("ent_id"), F.col("name").alias("text")).distinct()
    to = _edges(pairs, "mentions", W["mentions"], 1)
    back = _edges(pairs.withColumns({"src": F.col("dst"), "dst": F.col("src")}), "mentioned_in", W["mentioned_in"], 1)
    return nodes, to.unionByName(back)


def entity_relations(spans: DataFrame) -> DataFrame:
    """An edge between the first two entities of a span that has two."""
    two = spans.select("doc_id", F.slice("entities", 1, 2).alias("e")).filter(F.size("e") == 2)
    rows = two.select("doc_id", F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst")).filter("src <> dst").distinct()
    return _edges(rows, "entity_relation", W["entity_relation"], 1)


def text_mentions(texts: DataFrame, names: DataFrame, longest: int = 5) -> DataFrame:
    """doc_id, node_id, name for names that occur as whole words in a text.

    A name is looked up by all its words, the first `longest` of them if it has more, among the texts' word n-grams of
    the lengths that names have, an equi-join; what is found is checked by the regular expression, whatever stands
    between the words. names: doc_id, name (lower case); names without a word character are found nowhere.
    """
    words_of = lambda x: F.regexp_extract_all(F.lower(x), F.lit(X.WORD), 1)
    keyed = names.select("doc_id", "name", F.slice(words_of(F.col("name")), 1, longest).alias("nw")).filter(F.size("nw") > 0)
    keyed = keyed.select("doc_id", "name", F.size("nw").alias("size"), F.array_join("nw", " ").alias("gram")).distinct()
    words = texts.select("doc_id", "node_id", F.lower("text").alias("low"), words_of(F.col("text")).alias("w"))
    sized = words.join(keyed.groupBy("doc_id").agg(F.collect_set("size").alias("sizes")), "doc_id")  # `longest` values at most
    grams = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda k: F.array_join(F.slice("w", k, n), " "))))
    rows = sized.select("doc_id", "node_id", "low", F.explode(F.array_distinct(grams)).alias("gram")).join(keyed, ["doc_id", "gram"])
    exact = F.expr("low rlike concat('\\\\b\\\\Q', name, '\\\\E\\\\b')")
    return rows.filter(F.contains(F.col("low"), F.col("name")) & exact).select("doc_id", "node_id", "name").distinct()
