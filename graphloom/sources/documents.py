"""Document sources: question JSON, page tables, HTML pages and PDF files, and what is read off pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X

RECORD = "_id string, question string, answer string, type string, level string, context array<array<string>>"
PAGE = "doc_id string, page int, text string, blocks array<struct<text: string, max_font_size: double, is_bold: boolean>>, metadata map<string, string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array of records: q_id, question, answer, type, level, context (array of title and sentences)."""
    raw = spark.read.schema(RECORD).json(path, multiLine=True)
    context = F.transform("context", lambda p: F.struct(F.get(p, F.lit(0)).alias("title"), F.from_json(F.get(p, F.lit(1)), "array<string>").alias("sentences")))
    return raw.select(F.col("_id").alias("q_id"), "question", "answer", "type", "level", context.alias("context"))


def context_pages(questions: DataFrame) -> DataFrame:
    """doc_id, page (from 1), text: the title, a line break and the trimmed sentences joined by spaces."""
    rows = questions.select(F.col("q_id").alias("doc_id"), F.posexplode("context").alias("pos", "c"))
    body = F.array_join(F.transform("c.sentences", lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), " ")
    return rows.select("doc_id", (F.col("pos") + 1).alias("page"), F.concat("c.title", F.lit("\n"), body).alias("text"))


def context_sentences(questions: DataFrame) -> DataFrame:
    """q_id, ord, title, sentence; a context without a title is `unknown`."""
    rows = questions.select("q_id", F.posexplode("context").alias("page", "c"))
    return rows.select("q_id", "page", F.coalesce("c.title", F.lit("unknown")).alias("title"), F.posexplode("c.sentences").alias("pos", "sentence"))


def context_prompt(questions: DataFrame) -> DataFrame:
    """q_id and its contexts as lines `[title]: text`."""
    line = F.transform("context", lambda c: F.concat(F.lit("["), c["title"], F.lit("]: "), F.array_join(c["sentences"], " ")))
    return questions.select("q_id", F.array_join(line, "\n").alias("prompt"))


def flag_headings(pages: DataFrame) -> DataFrame:
    """Adds median_font_size and, to each block, is_heading: bold, or at least 2 over the page's median size."""
    sizes = pages.select("doc_id", "page", F.explode("blocks.max_font_size").alias("size")).groupBy("doc_id", "page").agg(F.median("size").alias("median_font_size"))
    joined = pages.join(sizes, ["doc_id", "page"], "left")
    flagged = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["max_font_size"].alias("max_font_size"), b["is_bold"].alias("is_bold"), (b["is_bold"] | (b["max_font_size"] >= F.col("median_font_size") + 2)).alias("is_heading")))
    return joined.withColumn("blocks", flagged)


def sections(pages: DataFrame, title: str = "title") -> DataFrame:
    """doc_id, section_id, title, pages: a page with a title starts a section, others join it; pages before any are `Introduction`."""
    order = Window.partitionBy("doc_id").orderBy("page")
    tagged = pages.withColumn("section_id", F.sum(F.when(F.col(title).isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.coalesce(F.min_by(title, "page"), F.lit("Introduction")).alias("title")
    return tagged.groupBy("doc_id", "section_id").agg(name, F.array_sort(F.collect_list("page")).alias("pages"))


def heading_of_page(pages: DataFrame) -> DataFrame:
    """Adds title: the text of the page's first heading block, or null."""
    return pages.withColumn("title", F.get(F.filter("blocks", lambda b: b["is_heading"]), F.lit(0))["text"])


def text_tables(pages: DataFrame) -> DataFrame:
    """doc_id, page, table_id, rows: at least two adjoining lines with an equal number, two or more, of cells.

    Cells are set apart by two or more spaces, else by pipes, tabs or commas.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\\n")).alias("line", "content")).filter(F.trim("content") != "")
    cut = lambda p: F.filter(F.transform(F.split(F.trim("content"), p), lambda c: F.trim(c)), lambda c: c != "")
    wide = cut("\\s{2,}")
    cells = lines.withColumn("cells", F.when(F.size(wide) >= 2, wide).otherwise(cut("[|\\t,]")))
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    width = F.when(F.size("cells") >= 2, F.size("cells")).otherwise(0)
    starts = F.when(F.coalesce(F.lag("width").over(order), F.lit(-1)) != F.col("width"), 1).otherwise(0)
    islands = cells.withColumn("width", width).withColumn("start", starts).withColumn("table_id", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("width >= 2")
    rows = islands.groupBy("doc_id", "page", "table_id").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("l"))
    return rows.filter(F.size("l") >= 2).select("doc_id", "page", "table_id", F.transform("l", lambda s: s["cells"]).alias("rows"))


def html_text(html) -> tuple:
    """Title and body text columns of an HTML column: scripts, styles, comments and tags removed, entities of markup restored."""
    title = X.squeeze(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(html, "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>", " ")
    body = F.regexp_replace(F.regexp_replace(body, "(?i)</(p|div|li|h[1-6]|tr)>|<br\\s*/?>", "\n"), "(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        title, body = F.replace(title, F.lit(a), F.lit(b)), F.replace(body, F.lit(a), F.lit(b))
    return title, F.trim(F.regexp_replace(F.regexp_replace(body, "[ \\t]+", " "), "\\s*\\n\\s*", "\n"))


def html_pages(pages: DataFrame) -> DataFrame:
    """doc_id (the url's host), page, title, text of a crawl table of page_id, url and html."""
    title, body = html_text(F.col("html"))
    return pages.select(F.parse_url("url", F.lit("HOST")).alias("doc_id"), F.col("page_id").alias("page"), title.alias("title"), body.alias("text"))


def read_pdfs(spark: SparkSession, path: str, ocr=None) -> DataFrame:
    """Pages of PDF files, in the PAGE schema; needs the optional module pymupdf on the executors.

    ocr, an optional function from a page image in PNG to text, is used for pages without text; pages that stay
    without are left out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for pdf in parts:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for number, page in enumerate(doc, 1):
                        blocks = []
                        for b in page.get_text("dict")["blocks"]:
                            spans = [s for line in b.get("lines", []) for s in line["spans"]]
                            text = " ".join(s["text"] for s in spans).strip()
                            if text:
                                blocks.append({"text": text, "max_font_size": max(s["size"] for s in spans), "is_bold": any(s["flags"] & 16 for s in spans)})
                        text = "\n\n".join(b["text"] for b in blocks) or (ocr(page.get_pixmap().tobytes("png")) if ocr else "")
                        if text.strip():
                            rows.append((name, number, text, blocks, {k: str(v) for k, v in (doc.metadata or {}).items()}))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "blocks", "metadata"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, PAGE).withColumn("text", X.clean_page_text(F.col("text")))


def read_pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, table_id, rows of the ruled tables of PDF files, cells trimmed, rows without text left out; needs the optional module pdfplumber on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for pdf in parts:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as doc:
                    for number, page in enumerate(doc.pages, 1):
                        for k, found in enumerate(page.extract_tables()):
                            cells = [[(c or "").strip() for c in r] for r in found]
                            kept = [r for r in cells if any(r)]
                            if kept:
                                rows.append((name, number, k, kept))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "table_id", "rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "doc_id string, page int, table_id long, rows array<array<string>>")


def read_document(pages: DataFrame) -> dict[str, DataFrame]:
    """Pages with headings, sections and tables of extracted pages."""
    flagged = heading_of_page(flag_headings(pages))
    return {"pages": flagged, "sections": sections(flagged), "tables": text_tables(flagged)}
