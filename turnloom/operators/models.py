"""Batch models as columns: domain labels, summaries and embeddings from any function of a list of texts.

A model is loaded once in a worker and sees lists of at most `batch_size` texts. Where it raises, the texts are asked one by
one and those that fail alone get null, so callers take their rule path; null texts are not asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list[str]], list]
BATCH = 64
LABEL = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

_LOADED: dict[str, Model] = {}


def loaded(name: str, make_model: Callable[[], Model]) -> Model:
    """The worker's model of that name."""
    if name not in _LOADED:
        _LOADED[name] = make_model()
    return _LOADED[name]


def answers(model: Model, texts: list[str]) -> list:
    """An answer for each text, null where the model fails on it."""
    try:
        out = list(model(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} answers to {len(texts)} texts")
        return out
    except Exception:  # noqa: BLE001  whatever a model raises
        return [None] if len(texts) == 1 else [answers(model, [t])[0] for t in texts]


def infer(rows: DataFrame, column: str, make_model: Callable[[], Model], result: T.DataType, out: str, batch_size: int = BATCH, name: str | None = None) -> DataFrame:
    """Adds `out`, the model's answer to the text in `column`. Calls that give the same `name` share a worker's model."""
    name = name or uuid.uuid4().hex

    def answered(batch: pd.Series) -> list:
        texts = [None if pd.isna(t) else t for t in batch]
        asked, found = [i for i, t in enumerate(texts) if t is not None], [None] * len(texts)
        for at in range(0, len(asked), batch_size):
            some = asked[at : at + batch_size]
            for i, answer in zip(some, answers(loaded(name, make_model), [texts[i] for i in some]), strict=True):
                found[i] = answer
        return found

    if isinstance(result, T.StructType):

        @F.pandas_udf(result)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = answered(batch)
                yield pd.DataFrame({f: [None if a is None else a[k] for a in found] for k, f in enumerate(result.names)})
    else:

        @F.pandas_udf(result)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(answered(batch), dtype=object)

    return rows.withColumn(out, run(F.col(column)))


def labels(contexts: DataFrame, make_model: Callable[[], Model], batch_size: int = BATCH) -> DataFrame:
    """(conv_id, turn, label, score) from model_context rows; the model gives (label, score) for each text."""
    asked = infer(contexts, "context", make_model, LABEL, "answer", batch_size)
    return asked.select("conv_id", "turn", "answer.label", "answer.score")


def summaries(inputs: DataFrame, make_model: Callable[[], Model], batch_size: int = BATCH) -> DataFrame:
    """(conv_id, summary) from model_summary_input rows, for compress_with_summary."""
    return infer(inputs, "model_input", make_model, T.StringType(), "summary", batch_size).select("conv_id", "summary")


def embedded(rows: DataFrame, column: str, make_model: Callable[[], Model], batch_size: int = BATCH) -> DataFrame:
    """Adds embedding, for similar_reply and reply_reuse; a text without a vector can neither be found nor find."""
    found = infer(rows, column, make_model, T.ArrayType(T.DoubleType()), "embedding", batch_size)
    return found.filter(F.col("embedding").isNotNull())
