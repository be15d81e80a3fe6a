"""Rows of a vector column on which the operators for embeddings work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: str) -> Column:
    """Whether the vector is there, has entries, and none of them is null, NaN or infinite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: number(x.cast("double"))), F.lit(False))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vectors have the commonest number of entries (of several the smallest), and that number; 0 for an empty table."""
    most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    wide = most["d"] if most else 0
    return rows.filter(F.size(vector) == wide), wide


def matrix(column: pa.Array, wide: int, kind: type = np.float64) -> np.ndarray:
    """The vectors of a column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), wide)

