"""Bounded segments of an ordered group.

A conversation (or key, or owner) may hold a large share of all rows, so ordered work never
runs over a whole group in one task. Rows are cut into segments by their order column, every
window and join is keyed by (group, segment), and what a segment needs from earlier ones comes
from a small table with one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per segment are at most this many as long as the order column holds distinct integers.
SEGMENT = 512


def segment_of(order: Column, size: int = SEGMENT) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def segment_offsets(rows: DataFrame, keys: list[str], seg: str = "seg", count: str = "n") -> DataFrame:
    """Rows before each segment and in its whole group, from a table with one row per segment."""
    w = Window.partitionBy(*keys).orderBy(seg)
    before = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(count).over(Window.partitionBy(*keys))
    return rows.select(
        *keys, seg, F.coalesce(before, F.lit(0)).cast("long").alias("offset"), total.cast("long").alias("n_rows")
    )


def numbered(rows: DataFrame, keys: list[str], order: list[str], seg: str, out: str = "pos") -> DataFrame:
    """0-based position in the group and group size, without a window over the whole group.

    ``seg`` is a column of ``rows`` that grows with the order. The rows are shuffled once, by
    (keys, seg); only one small row per segment travels again.
    """
    sizes = rows.groupBy(*keys, seg).agg(F.count(F.lit(1)).alias("n"))
    offsets = segment_offsets(sizes, keys, seg)
    w = Window.partitionBy(*keys, seg).orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    return (
        ranked.join(offsets, [*keys, seg])
        .withColumn(out, F.col("offset") + F.col("_rn") - 1)
        .drop("_rn", "offset")
    )


def top_per_group(
    rows: DataFrame, keys: list[str], order: list[Column], k: int, seg: str | None = None, rank: str = "rank"
) -> DataFrame:
    """The first k rows of each group in two steps: per segment, then over the survivors.

    Without ``seg`` Spark's own group limit (row_number <= k pushed below the shuffle) does the
    first step per input task.
    """
    if seg is not None:
        local = Window.partitionBy(*keys, seg).orderBy(*order)
        rows = rows.withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
