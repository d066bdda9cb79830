"""Where models are called: texts, images and pairs to vectors, scores, texts or rows. What a model is, the caller gives.

``model()`` is made once in a task, so weights are loaded once by a worker, and called with lists of inputs. A batch that
fails has the result for failures, as one that is lost must not lose the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[], Callable[..., list]]


def applied(rows: DataFrame, model: Model, inputs: list[str], kind: str, out: str = "answer", failed: Any = None, batch: int = 50) -> DataFrame:
    """``rows`` with ``out`` of a DDL type: the model's results for lists of the inputs, ``batch`` at a time."""
    names = [*rows.columns, out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for frame in frames:
            found: list = []
            for at in range(0, len(frame), batch):
                part = [frame[c].iloc[at : at + batch].tolist() for c in inputs]
                try:
                    got = list(ask(*part))
                    if len(got) != len(part[0]):
                        raise ValueError("a model has to give one result for each input")
                except Exception:  # noqa: BLE001
                    got = [failed] * len(part[0])
                found += got
            yield frame.assign(**{out: pd.Series(found, index=frame.index, dtype=object)})[names]

    schema = ", ".join([f"`{c}` {k}" for c, k in rows.dtypes] + [f"`{out}` {kind}"])
    return rows.mapInPandas(run, schema)


def answers(docs: DataFrame, key: str, text: str, model: Model, batch: int = 50) -> DataFrame:
    """(key, answer) of a text model; failed batches have empty answers, null texts count as empty."""
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias(text))
    return applied(rows, model, [text], "string", "answer", "", batch).select(key, "answer")


def embeddings(rows: DataFrame, key: str, content: str, model: Model, batch: int = 50) -> DataFrame:
    """(key, embedding) of a model of texts or images (bytes); failed batches have empty vectors."""
    return applied(rows.select(key, content), model, [content], "array<float>", "embedding", [], batch).select(key, "embedding")


def pair_scores(hits: DataFrame, query: str, content: str, model: Model, batch: int = 32) -> DataFrame:
    """``hits`` with ``rerank_score`` of a model that is given lists of queries and of contents; null where it failed."""
    rows = hits.withColumn("_q", F.lit(query))
    return applied(rows, model, ["_q", content], "double", "rerank_score", None, batch).drop("_q")


def extracted(docs: DataFrame, key: str, text: str, model: Model, parse: Callable[[Column], Column], batch: int = 8) -> DataFrame:
    """(key, and the fields of ``parse``) of a model's answers, such as ``entities.parse_answer`` of keywords and a summary; nulls where neither came."""
    return answers(docs, key, text, model, batch).select(key, parse(F.col("answer")).alias("a")).select(key, "a.*")
