"""Memory written from a stream of sources, one idempotent folder per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.memory import page_sections
from turnloom.operators.turns import keep_last

TRAIL = 8


def memory_sink(path: str, sections_of: Callable[[DataFrame], DataFrame] = page_sections) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends the batch's sources and the page sections they add.

    The folder of a batch is overwritten on a retry, so a repeated batch changes nothing. A section's
    source trail needs the last few earlier sources of its owner: ids and titles only, found with a
    per-task limit, never the earlier contents.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/sources/batch={batch_id}")
        new = spark.read.parquet(f"{path}/sources/batch={batch_id}")
        stored = spark.read.option("basePath", f"{path}/sources").parquet(f"{path}/sources")
        earlier = stored.filter(F.col("batch") < batch_id).select("owner", "seq", "source_id", "title")
        touched = earlier.join(new.select("owner").distinct(), "owner", "left_semi")
        # only listed in trails: their own sections were written by their batch
        before = keep_last(touched, ["owner"], "seq", TRAIL, "source_id").withColumn("content", F.lit("-"))
        sections = sections_of(new.unionByName(before, allowMissingColumns=True))
        own = sections.join(new.select("owner", "seq"), ["owner", "seq"], "left_semi")
        own.write.mode("overwrite").parquet(f"{path}/sections/batch={batch_id}")

    return write


def read_sections(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/sections").parquet(f"{path}/sections").drop("batch")
