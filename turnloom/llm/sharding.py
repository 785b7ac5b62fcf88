"""Sharding by weighted rendezvous hashing, in SQL functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import shuffle_partitions, stored

SHARDS = 24
BITS = 52  # of a hash that make a draw, exact in a double


def hashed(*parts: Column) -> Column:
    """A stable hash of the parts, from 0 to 2^52 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BITS)


def draw(key: Column, salt: int) -> Column:
    """A number strictly between 0 and 1 for a key and a salt."""
    return (hashed(key, F.lit(salt)) + 0.5) / float(2**BITS)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(draw) / weight: each wins in proportion to its weight, whoever else takes part."""
    costs = [F.struct((-F.log(draw(key, s)) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*costs))["shard"]


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The id alone decides the shard among `weights`; grown_shard is its place when one shard of `grown_weight` joins, and
    differs only for rows that the new shard takes. Rows with a null id count as one key. Equal ids share a shard, repeated
    rows get slots of their own; a null text has no bytes. Slots order a shard by a hash of id and text, so they don't depend
    on partitions; they are counted in ranges of that hash, so no task holds a shard.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    ranges = 4 * shuffle_partitions(docs.sparkSession)
    placed = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            winner(key, weights).alias("shard"),
            winner(key, [*weights, grown_weight]).alias("grown_shard"),
            hashed(key, F.crc32(text)).alias("place"),
        ).withColumn("range", F.floor(F.col("place") / float(2**BITS) * ranges).cast("int")),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    first = first.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "range").orderBy("place", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(first, ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
