"""Vectors in tables and in matrices: what the searches over embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    one = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, one), F.lit(False))


def dimensions(rows: DataFrame, vector: str = "vector") -> int:
    """Components of the longest vector."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles, short ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def lists(table: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    ends = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(table).ravel()))


def binary(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def first_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the first rows of each group, by score downwards and id, in that order."""
    order = np.lexsort((ids, -scores, groups))
    sorted_groups = groups[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_groups[1:] != sorted_groups[:-1]
    starts = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < most]
