"""Sinks: document JSON, reports, graph exports and comparison tables. Paths are of any file system that Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import escape_html


def write_documents(pages: DataFrame, path: str) -> None:
    """One JSON object a document, with its pages in order."""
    body = F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages")
    pages.groupBy("doc_id").agg(body).write.mode("overwrite").json(path)


def write_report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """The summary as one JSON object, and the records beside it, partitioned as they are."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")


def report_lines(records: DataFrame) -> DataFrame:
    """The text report: one line a question."""
    line = F.format_string("[%s/%s] %s | gold: %s | predicted: %s | EM %.4f | F1 %.4f", "level", "type", "question", "gold_answer", F.coalesce("predicted_answer", F.lit("")), "exact_match", "f1")
    return records.select("q_id", line.alias("value"))


def write_text_report(records: DataFrame, path: str) -> None:
    report_lines(records).select("value").write.mode("overwrite").text(path)


def append_checkpoint(records: DataFrame, path: str, every: int = 100) -> None:
    """Appends finished records as Parquet partitions of `every` questions: a rerun resumes after those present."""
    batch = F.floor((F.col("q_num") - 1) / every).cast("int")
    records.withColumn("batch_id", batch).write.mode("append").partitionBy("batch_id").parquet(path)


def remaining(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without a stored record."""
    return questions.join(done.select("q_id").distinct(), "q_id", "left_anti")


def graph_json(nodes: DataFrame, edges: DataFrame, text_length: int = 100) -> DataFrame:
    """doc_id and its graph as one JSON text: nodes with texts cut to `text_length`, and edges."""
    n = nodes.withColumn("text", F.substring("text", 1, text_length)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "type", "weight"))).alias("edges"))
    none = F.array().cast(e.schema["edges"].dataType)
    return n.join(e, "doc_id", "left").select("doc_id", F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"))).alias("json"))


def kg_json(nodes: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id and its knowledge graph with statistics as JSON."""
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("text", "label", "frequency"))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "relation", "weight"))).alias("edges"))
    s = stats.select("doc_id", F.struct(*[c for c in stats.columns if c != "doc_id"]).alias("stats"))
    return n.join(e, "doc_id", "left").join(s, "doc_id", "left").select("doc_id", F.to_json(F.struct("nodes", "edges", "stats")).alias("json"))


def graphml(nodes: DataFrame, edges: DataFrame, node: str = "node_id", lists: tuple[str, ...] = ("entities",)) -> DataFrame:
    """doc_id and its graph as a GraphML text: list attributes as comma-joined text, embeddings left out."""
    attributes = [c for c in nodes.columns if c not in ("doc_id", node, "embedding")]
    cell = {c: F.array_join(c, ",") if c in lists else F.col(c).cast("string") for c in attributes}
    data = F.concat(*(F.concat(F.lit(f'<data key="{c}">'), escape_html(F.coalesce(x, F.lit(""))), F.lit("</data>")) for c, x in cell.items()))
    n = nodes.select("doc_id", F.concat(F.lit('<node id="'), escape_html(F.col(node).cast("string")), F.lit('">'), data, F.lit("</node>")).alias("x"))
    extra = [c for c in ("type", "relation") if c in edges.columns]
    kinds = [F.concat(F.lit(f'<data key="edge_{c}">'), escape_html(F.coalesce(F.col(c), F.lit(""))), F.lit("</data>")) for c in extra]
    e = edges.select("doc_id", F.concat(F.lit('<edge source="'), escape_html(F.col("src").cast("string")), F.lit('" target="'), escape_html(F.col("dst").cast("string")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data>"), *kinds, F.lit("</edge>")).alias("x"))
    body = n.withColumn("k", F.lit(0)).unionByName(e.withColumn("k", F.lit(1))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "\n").alias("body"))
    keys = "".join(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in attributes) + '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>'
    keys += "".join(f'<key id="edge_{c}" for="edge" attr.name="{c}" attr.type="string"/>' for c in extra)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">\n'
    return body.select("doc_id", F.concat(F.lit(head), "body", F.lit("\n</graph></graphml>")).alias("graphml"))


def node_colours(nodes: DataFrame, by: str, colours: dict[str, str], other: str = "gray") -> DataFrame:
    """Nodes with the colour in which a renderer draws them."""
    pairs = [x for k, v in colours.items() for x in (F.lit(k), F.lit(v))]
    return nodes.withColumn("color", F.coalesce(F.element_at(F.create_map(*pairs), F.col(by)), F.lit(other)))


def level_rows(records: DataFrame, by_level: DataFrame | None = None) -> DataFrame:
    """system, level, questions, exact_match, f1: from the analyses' own level rows, or for systems without any counted from their records.

    records: system, level, exact_match, f1; by_level: system, level, questions, exact_match, f1.
    """
    means = (F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in ("exact_match", "f1"))
    counted = records.groupBy("system", "level").agg(F.count(F.lit(1)).alias("questions"), *means)
    if by_level is None:
        return counted
    return by_level.select(counted.columns).unionByName(counted.join(by_level.select("system").distinct(), "system", "left_anti"))


def write_comparison(table: DataFrame, path: str) -> None:
    """A comparison table as JSON, and as text with padded columns."""
    table.write.mode("overwrite").json(f"{path}/json")
    line = F.concat_ws("  ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("N/A")), 24, " ") for c in table.columns))
    table.select(F.rtrim(line).alias("value")).write.mode("overwrite").text(f"{path}/text")


def comparison_table(analyses: DataFrame, metrics: list[str], most: int = 100) -> DataFrame:
    """metric by system, `N/A` where a system lacks it; at most `most` systems. analyses: system and the metric columns."""
    long = analyses.select("system", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("system", "m.metric", "m.value")
    names = analyses.select("system").distinct().orderBy("system").limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"a table has at most {most} systems as columns")
    systems = [r["system"] for r in names]
    wide = long.groupBy("metric").pivot("system", systems).agg(F.first("value"))
    return wide.select("metric", *(F.coalesce(F.format_number(s, 4), F.lit("N/A")).alias(s) for s in systems))
