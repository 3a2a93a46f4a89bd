"""Embedding columns as arrays, and spherical k-means over a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as doubles, where each vector starts (one more at the end), and which take part.

    A vector takes no part if it is null or empty, holds a null, a NaN or an infinity, or is zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.append(0, np.cumsum(sizes))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.zeros(len(sizes), bool)
    full = sizes > 0
    if full.any():
        # scaled down, so that no square overflows
        first = starts[:-1][full]
        most = np.maximum.reduceat(np.abs(flat), first)
        good[full] = np.isfinite(most) & (most > 0)
    return flat, starts, good


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their lengths."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def sampled(vectors: DataFrame, id_col: str, column: str, most: int) -> tuple[list[int], np.ndarray]:
    """Ids and vectors of at most ``most`` rows, drawn by a hash of the id; of the commonest dimension.

    This is all that reaches the driver: a bound that doesn't depend on the table.
    """
    drawn = vectors.select(id_col, column).orderBy(F.xxhash64(id_col), id_col).limit(most).toArrow()
    flat, starts, good = rows_of(drawn.column(column))
    sizes = np.diff(starts)
    if not good.any():
        return [], np.zeros((0, 0))
    dims, counts = np.unique(sizes[good], return_counts=True)
    dim = int(dims[counts.argmax()])
    keep = np.flatnonzero(good & (sizes == dim))
    ids = drawn.column(id_col).to_pylist()
    return [ids[i] for i in keep], np.stack([flat[starts[i] : starts[i + 1]] for i in keep])


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of unit rows; a cell left empty keeps its centre."""
    centres = rows[:cells].copy()
    for _ in range(rounds):
        home = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        length = np.sqrt((sums * sums).sum(1))
        centres[length > 1e-12] = sums[length > 1e-12] / length[length > 1e-12, None]
    return centres
