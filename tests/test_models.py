"""Batch models: one load in a worker, bounded lists, nulls where the model fails."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators import models


def made():
    """A model as workers get it, which cannot import this file."""

    def strict(texts):
        if len(texts) > 3 or any("bad" in t for t in texts):
            raise ValueError
        return [t.upper() for t in texts]

    return strict


strict = made()


def test_failing_texts_are_asked_alone():
    assert models.answers(strict, ["a", "bad", "c"]) == ["A", None, "C"]
    assert models.answers(lambda texts: [1], ["a", "b"]) == [1, 1]
    assert models.answers(lambda texts: [], ["a"]) == [None]


@pytest.mark.parametrize("size", [1, 3])
def test_infer(spark, size):
    model = made()
    factory = lambda: model
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(["a", None, "bad", "", "e"] * 4)], "id int, text string, out2 int").repartition(2)
    got = models.infer(rows, "text", factory, T.StringType(), "out", size, name=f"strict{size}").collect()
    assert sorted((r.id, r.out) for r in got) == [(i, ["A", None, None, "", "E"][i % 5]) for i in range(20)]
    assert models.infer(rows.limit(0), "text", factory, T.StringType(), "out", size, name="none").count() == 0


def test_labels_summaries_embeddings(spark):
    contexts = spark.createDataFrame([(1, 0, "a"), (1, 1, "bad")], "conv_id long, turn long, context string")
    strict = made()
    answer = lambda texts: [(t, 0.5) for t in strict(texts)]
    assert sorted(map(tuple, models.labels(contexts, lambda: answer).collect())) == [(1, 0, "A", 0.5), (1, 1, None, None)]
    inputs = contexts.select("conv_id", F.col("context").alias("model_input"))
    assert sorted(r.summary or "" for r in models.summaries(inputs, lambda: strict).collect()) == ["", "A"]
    vectors = models.embedded(contexts, "context", lambda: lambda texts: [[float(len(t)), 1.0] for t in strict(texts)])
    assert [(r.turn, r.embedding) for r in vectors.collect()] == [(0, [1.0, 1.0])]
