"""Plug points for external models. Each takes a loader that runs once in a Python worker; each has a built-in fallback.

A loader is a function without arguments that returns a function from a list of inputs to a list of outputs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

Loader = Callable[[], Callable[[list], list]]
WIDTH = 384


def embed(x: Column, loader: Loader | None = None, width: int = WIDTH) -> Column:
    """Embeddings of texts; zeros without a model."""
    if loader is None:
        return F.array_repeat(F.lit(0.0).cast("float"), width)

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for part in parts:
            yield pd.Series(model(part.fillna("").tolist()))

    return run(x)


def label(x: Column, loader: Loader | None, fallback: Column) -> Column:
    """A model's class of each text; the fallback's without one or where it gives none."""
    if loader is None:
        return fallback

    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for part in parts:
            yield pd.Series(model(part.fillna("").tolist()), dtype=object)

    return F.coalesce(run(x), fallback)


def rerank(rows: DataFrame, loader: Loader | None = None, text: str = "text", query: str = "question") -> DataFrame:
    """Adds rerank: a cross-encoder's score of each pair; the present score without a model."""
    if loader is None:
        return rows.withColumn("rerank", F.col("score"))

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loader()
        for a, b in parts:
            yield pd.Series(model(list(zip(a, b, strict=True))), dtype=float)

    return rows.withColumn("rerank", run(F.col(query), F.col(text)))


def extract_rows(rows: DataFrame, loader: Loader, schema: str, text: str = "text") -> DataFrame:
    """A model that gives several rows (entities, triples) a text: the key columns of rows and the model's columns.

    schema names the model's columns; its function returns a list of dicts for each text.
    """
    keys = [c for c in rows.columns if c != text]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in parts:
            found = model(pdf[text].fillna("").tolist())
            out = [dict(zip(keys, values, strict=True)) | f for values, each in zip(pdf[keys].itertuples(index=False, name=None), found, strict=True) for f in each]
            yield pd.DataFrame(out, columns=[*keys, *(s.split()[0] for s in schema.split(","))])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def read_answers(contexts: DataFrame, loader: Loader | None = None) -> DataFrame:
    """Adds answer and qa_score to rows of question and context; without a reader both are empty, so that retrieval decides."""
    if loader is None:
        return contexts.withColumns({"answer": F.lit(""), "qa_score": F.lit(0.0)})

    kinds = contexts.dtypes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in parts:
            found = model(list(zip(pdf["question"], pdf["context"], strict=True)))
            yield pdf.assign(answer=[f[0] for f in found], qa_score=[float(f[1]) for f in found])

    return contexts.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in kinds) + ", answer string, qa_score double")


STOPS = ("\n\n", "Question:", "Context:")


def ask_model(prompts: DataFrame, loader: Loader, pause: float = 0.2) -> DataFrame:
    """Adds answer, latency_ms: a text generator's first line for each prompt, cut at the stops; ERROR where it fails."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in parts:
            answers, times = [], []
            for p in pdf["prompt"]:
                began = time.time()
                try:
                    text = model([p])[0]
                    for s in STOPS:
                        text = text.split(s)[0]
                    answers.append(text.strip().split("\n")[0].strip())
                except (OSError, TimeoutError, RuntimeError):
                    answers.append("ERROR")
                times.append((time.time() - began) * 1000)
                time.sleep(pause)
            yield pdf.assign(answer=answers, latency_ms=times)

    return prompts.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in prompts.dtypes) + ", answer string, latency_ms double")


def closed_book_prompt(question: Column) -> Column:
    return F.concat(F.lit("Answer the question with a short phrase.\nQuestion: "), question, F.lit("\nAnswer:"))


def context_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the context with a short phrase.\nContext:\n"), context, F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))
