"""Helpers the operators share: the table, stored intermediate tables, text batches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ESTIMATED = "spark.sql.autoBroadcastJoinThreshold"
MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage and survives lost executors; the shuffle files of the writing job are given back when it ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/turnloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside broadcast a table for a join only by the size that its shuffle had, not by an estimate.

    Estimates follow the size of a file: an explode of a few compressed columns counts as no larger than they are.
    """
    before = {name: spark.conf.get(name, None) for name in (ESTIMATED, MEASURED)}
    spark.conf.set(MEASURED, before[MEASURED] or spark.conf.get(ESTIMATED))
    spark.conf.set(ESTIMATED, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def remainder_of(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty, one at a time and without decoding."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def text_strings(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of runs of rows of about `limit` bytes; a longer text is a run of its own. Columns: id, text."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0), text_bytes(batch.column(1)), strict=True):
            if ids and size + len(text) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key.as_py())
            texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts
