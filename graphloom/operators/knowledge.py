"""Knowledge graphs: triples from sentences, their graph, statistics and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graphs
from graphloom.operators.evaluation import first_of
from graphloom.sources.storage import cut


def related_triples(sentences: DataFrame, entities: str = "entities", longest: int = 5) -> DataFrame:
    """doc_id, subject, relation, object, label, ord: each entity of a sentence and the next are `related_to`.

    The built-in extractor; a parser's triples with the same columns can take its place. Entities are `TYPE:name`
    strings; those of more than `longest` words are passed over.
    """
    rows = sentences.select("doc_id", "node_id", F.posexplode(entities).alias("pos", "e"))
    named = rows.select("doc_id", "node_id", "pos", F.substring_index("e", ":", 1).alias("label"), F.expr("substring(e, instr(e, ':') + 1)").alias("name")).filter(X.word_count(F.col("name")) <= longest)
    after = Window.partitionBy("doc_id", "node_id").orderBy("pos")
    pairs = named.withColumn("object", F.lead("name").over(after)).filter("object is not null")
    return pairs.select("doc_id", F.col("name").alias("subject"), F.lit("related_to").alias("relation"), "object", F.col("label"), F.struct("node_id", "pos").alias("ord"))


NAME = r"[A-Z][\p{L}\p{N}'-]*(?:\s+[A-Z][\p{L}\p{N}'-]*)*"
#: Rule forms of a parser's triples, in the order of their claims on a sentence: pattern, and how its groups make subject, relation, object.
TRIPLE_RULES = [
    ("passive", rf"({NAME})\s+(?:is|are|was|were)\s+(\p{{Ll}}+ed)\s+by\s+(?:the\s+)?({NAME})"),
    ("verb", rf"({NAME})\s+(\p{{Ll}}{{2,}}(?:ed|s)(?:\s+(?:in|on|at|to|from|of|with|for))?)\s+(?:the\s+)?({NAME})"),
    ("copula", rf"({NAME})\s+(is|are|was|were)\s+(?:(?:a|an|the)\s+)?([^.,;:!?]+)"),
]


def rule_triples(sentences: DataFrame, entities: str = "entities") -> DataFrame:
    """doc_id, subject, relation, object, label, ord of passive, verb and copula sentences; `related_to` triples where a sentence has none.

    The built-in extractor by rules over capitalised names. `X was VERBed by Y` gives (Y, is VERBed by, X), `X VERBs (in) Y`
    gives (X, VERBs in, Y), `X is a Z` gives (X, is, Z); a form of `be` before `VERBed by` is passive, not a copula.
    """
    found = None
    base = sentences.select("doc_id", "node_id", "text")
    for n, (kind, pattern) in enumerate(TRIPLE_RULES):
        part = lambda k, p=pattern: F.regexp_extract_all("text", F.lit(p), k)
        rows = base.select("doc_id", "node_id", "text", F.posexplode(F.arrays_zip(part(1).alias("x"), part(2).alias("v"), part(3).alias("y"))).alias("pos", "m"))
        subject, relation, object_ = F.col("m.x"), F.col("m.v"), F.trim(F.col("m.y"))
        if kind == "passive":
            subject, relation, object_ = object_, F.concat(F.lit("is "), relation, F.lit(" by")), subject
        elif kind == "verb":
            rows = rows.filter(~F.col("m.v").isin("is", "was", "has", "does"))
        else:
            relation = F.lit("is")
            rows = rows.filter(~F.col("m.y").rlike("^\\p{Ll}+ed\\s+by\\s"))
        each = rows.select("doc_id", subject.alias("subject"), relation.alias("relation"), object_.alias("object"), F.lit("entity").alias("label"), F.struct("node_id", (F.col("pos") + 1000 * n).alias("pos")).alias("ord"))
        found = each if found is None else found.unionByName(each)
    found = found.select("doc_id", "subject", "relation", "object", "label", F.struct(F.col("ord.node_id").cast("long").alias("node_id"), F.col("ord.pos").cast("long").alias("pos")).alias("ord"))
    without = sentences.join(found.select("doc_id", F.col("ord.node_id").alias("node_id")).distinct(), ["doc_id", "node_id"], "left_anti")
    rest = related_triples(without, entities)
    return found.unionByName(rest.select("doc_id", "subject", "relation", "object", "label", F.struct(F.col("ord.node_id").cast("long").alias("node_id"), F.col("ord.pos").cast("long").alias("pos")).alias("ord")))


def valid_triples(triples: DataFrame) -> DataFrame:
    """Normalised subject and object of at least 2 characters each and different."""
    normal = triples.withColumns({"subject": X.normalize_entity(F.col("subject")), "object": X.normalize_entity(F.col("object"))})
    return normal.filter((F.length("subject") >= 2) & (F.length("object") >= 2) & (F.col("subject") != F.col("object")))


def kg_edges(triples: DataFrame) -> DataFrame:
    """doc_id, src, dst, relation (the first), weight (how often)."""
    return triples.groupBy("doc_id", F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.min_by("relation", "ord").alias("relation"), F.count(F.lit(1)).cast("double").alias("weight"))


def kg_nodes(triples: DataFrame) -> DataFrame:
    """doc_id, text, label (the first real one, else `entity`), frequency over both ends."""
    ends = triples.select("doc_id", F.col("subject").alias("text"), "label", "ord", F.lit(0).alias("side")).unionByName(triples.select("doc_id", F.col("object").alias("text"), F.lit("entity").alias("label"), "ord", F.lit(1).alias("side")))
    real = F.min_by("label", F.when(F.col("label") != "entity", F.struct("ord", "side")))
    return ends.groupBy("doc_id", "text").agg(F.coalesce(real, F.lit("entity")).alias("label"), F.count(F.lit(1)).alias("frequency"))


def as_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("doc_id").alias("graph"), "src", "dst", "weight")


def kg_metrics(edges: DataFrame, iterations: int = 200) -> DataFrame:
    """doc_id, text, pagerank (6 places), community."""
    g = cut(as_graph(edges))
    rank = graphs.pagerank(g, iterations=iterations, tolerance=1e-6)
    return rank.join(graphs.communities(g), ["graph", "node"]).select(F.col("graph").alias("doc_id"), F.col("node").alias("text"), F.round("pagerank", 6).alias("pagerank"), "community")


def kg_stats(nodes: DataFrame, edges: DataFrame, components: bool = False) -> DataFrame:
    """doc_id, nodes, edges, labels (map of counts), density and, if asked for, whether it is weakly connected and its number of communities."""
    labels = nodes.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"), F.sum("n").alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"))
    out = labels.join(e, "doc_id", "left").na.fill(0, ["edges"])
    out = out.withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0))
    if components:
        c = graphs.connected_components(as_graph(edges)).groupBy(F.col("graph").alias("doc_id")).agg((F.count_distinct("component") == 1).alias("connected"))
        groups = graphs.communities(as_graph(edges)).groupBy(F.col("graph").alias("doc_id")).agg(F.count_distinct("community").alias("communities"))
        out = out.join(c, "doc_id", "left").join(groups, "doc_id", "left")
    return out


def top_entities(nodes: DataFrame, k: int = 20, by: str = "pagerank") -> DataFrame:
    """The k highest of each document, ties by text."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(by), "text")
    return nodes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def entities_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.lower("label") == label.lower())


def match_entity(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, name, start: the node equal to the asked name, else the one of the highest PageRank that contains it or is in it.

    asked: doc_id, name. Names are compared normalised; the candidates are the document's own nodes.
    """
    q = asked.select("doc_id", "name", X.normalize_entity(F.col("name")).alias("q")).filter("q <> ''")
    rows = q.join(nodes, "doc_id").filter(F.contains(F.col("text"), F.col("q")) | F.contains(F.col("q"), F.col("text")))
    best = first_of(rows, [F.col("doc_id"), F.col("name")], [(F.col("text") == F.col("q")).desc(), F.desc("pagerank"), F.col("text")])
    return best.select("doc_id", "name", F.col("text").alias("start"))


def khop_triples(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """Distinct triples met within `hops` steps in either direction: doc_id, start, subject, relation, object, weight, hop; by falling weight."""
    g = as_graph(edges)
    inside = graphs.neighbourhood(g, starts.select(F.col("doc_id").alias("graph"), F.col("start").alias("node")), hops - 1, directed=False)
    seen = inside.select(F.col("graph").alias("doc_id"), "start", "node", (F.col("distance") + 1).alias("hop"))
    out = seen.join(edges.withColumn("node", F.col("src")), ["doc_id", "node"]).unionByName(seen.join(edges.withColumn("node", F.col("dst")), ["doc_id", "node"]))
    return out.groupBy("doc_id", "start", F.col("src").alias("subject"), "relation", F.col("dst").alias("object")).agg(F.max("weight").alias("weight"), F.min("hop").alias("hop"))


def entity_facts(edges: DataFrame, starts: DataFrame, hops: int = 2, most: int = 8) -> DataFrame:
    """doc_id, start and its first facts as strings, by weight."""
    t = khop_triples(edges, starts, hops)
    w = Window.partitionBy("doc_id", "start").orderBy(F.desc("weight"), "hop", "subject", "object")
    ranked = t.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return ranked.groupBy("doc_id", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", X.fact(F.col("subject"), F.col("relation"), F.col("object")).alias("f")))), lambda s: s["f"]).alias("facts"))


def resolved_paths(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Path evidence between asked names: doc_id, first, second, a, b, nodes, steps. Names are resolved as match_entity does.

    nodes: doc_id, text, pagerank; asked: doc_id, first, second. Pairs with an unknown name or without a path have no row.
    """
    names = asked.select("doc_id", F.col("first").alias("name")).union(asked.select("doc_id", F.col("second").alias("name"))).distinct()
    known = cut(match_entity(nodes, names))
    ends = asked.join(known.select("doc_id", F.col("name").alias("first"), F.col("start").alias("a")), ["doc_id", "first"]).join(known.select("doc_id", F.col("name").alias("second"), F.col("start").alias("b")), ["doc_id", "second"])
    ends = cut(ends.filter("a <> b"))
    return ends.join(path_evidence(edges, ends.select("doc_id", "a", "b").distinct()), ["doc_id", "a", "b"]).select("doc_id", "first", "second", "a", "b", "nodes", "steps")


def path_evidence(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, a, b, nodes, steps: a shortest undirected path and its steps `x -[relation]-> y`, the relation of the edge that exists.

    pairs: doc_id, a, b. Paths grow one edge a step from a, the smallest predecessor kept at each node, until nothing
    new is reached (or for `most` steps, if that is given). A pair without a path has no row.
    """
    links = cut(edges.select("doc_id", "src", "dst").union(edges.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = frontier = cut(pairs.select("doc_id", "a").distinct().select("doc_id", "a", F.col("a").alias("node"), F.array("a").alias("nodes")))
    step = 0
    while most is None or step < most:
        step += 1
        grown = frontier.select("doc_id", "a", F.col("node").alias("src"), "nodes").join(links, ["doc_id", "src"]).groupBy("doc_id", "a", F.col("dst").alias("node")).agg(F.min("nodes").alias("before"))
        frontier = cut(grown.join(seen.select("doc_id", "a", "node"), ["doc_id", "a", "node"], "left_anti").select("doc_id", "a", "node", F.concat("before", F.array("node")).alias("nodes")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = pairs.select("doc_id", "a", "b").join(seen.withColumnRenamed("node", "b"), ["doc_id", "a", "b"])
    steps = found.select("doc_id", "a", "b", "nodes", F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("x"), F.slice("nodes", 2, F.size("nodes")).alias("y"))).alias("pos", "s"))
    forward = edges.select("doc_id", F.col("src").alias("x"), F.col("dst").alias("y"), F.col("relation").alias("ab"))
    back = edges.select("doc_id", F.col("dst").alias("x"), F.col("src").alias("y"), F.col("relation").alias("ba"))
    named = steps.select("doc_id", "a", "b", "nodes", "pos", "s.x", "s.y").join(forward, ["doc_id", "x", "y"], "left").join(back, ["doc_id", "x", "y"], "left")
    line = F.concat("x", F.lit(" -["), F.coalesce("ab", "ba"), F.lit("]-> "), "y")
    return named.groupBy("doc_id", "a", "b", "nodes").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda s: s["l"]).alias("steps"))


def bridge_entities(paths: DataFrame) -> DataFrame:
    """The nodes between the ends of each path."""
    return paths.withColumn("bridges", F.slice("nodes", 2, F.greatest(F.size("nodes") - 2, F.lit(0))))


def bridge_evidence(nodes: DataFrame, edges: DataFrame, questions: DataFrame, pool: int = 20, entities: int = 6, steps: int = 3, most: int = 10) -> DataFrame:
    """doc_id, q_id, evidence: paths between the question's entities, of the `pool` most central nodes those that contain a question word.

    questions: doc_id, q_id, question. At most `entities` entities, `steps` steps a pair and `most` lines.
    """
    words = questions.select("doc_id", "q_id", F.array_distinct(X.answer_tokens(F.col("question"))).alias("words"))
    top = top_entities(nodes, pool)
    hit = top.join(words, "doc_id").filter(F.exists("words", lambda w: F.contains(F.col("text"), w)))
    w = Window.partitionBy("doc_id", "q_id").orderBy("rank")
    picked = cut(hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= entities).select("doc_id", "q_id", "n", "text"))
    b = picked.select("doc_id", "q_id", F.col("n").alias("nb"), F.col("text").alias("b"))
    pairs = cut(picked.select("doc_id", "q_id", F.col("n").alias("na"), F.col("text").alias("a")).join(b, ["doc_id", "q_id"]).filter("na < nb"))
    paths = path_evidence(edges, pairs.select("doc_id", "a", "b").distinct())
    lines = pairs.join(paths, ["doc_id", "a", "b"]).select("doc_id", "q_id", "na", "nb", F.posexplode(F.slice("steps", 1, steps)).alias("pos", "line"))
    order = Window.partitionBy("doc_id", "q_id").orderBy("na", "nb", "pos")
    kept = lines.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return kept.groupBy("doc_id", "q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]).alias("evidence"))


def align_sentences(sentences: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, node_id and the knowledge-graph entities that the sentence mentions as whole words."""
    from graphloom.operators.edges import text_mentions

    found = text_mentions(sentences, nodes.select("doc_id", F.col("text").alias("name")))
    return found.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_set("name")).alias("kg_entities"))
