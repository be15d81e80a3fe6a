"""Arrow batches inside tasks, cut so that the texts worked on at once stay small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut(batch: pa.RecordBatch, column: str, budget: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``budget`` bytes each, or a single longer text."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // budget
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, n]):
        yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, nulls as empty ones."""
    return [x or "" for x in batch.column(column).to_pylist()]
