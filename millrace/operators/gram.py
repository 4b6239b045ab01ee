"""Sums of products of all pairs of columns, for frames of any width.

A task keeps, for every two columns, the number of rows in which both have a value, the means of both
over those rows, and the sums of squares and products around these means. Each batch adds to them by
two or three matrix products. Such states merge in any order without losing digits; they are sent on
by blocks, one for each first column, and merged as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.util import check_columns, col, names

# Per first column i, an entry for every column j: rows with both, the means of i and of j over them,
# and the sums of squares of i, of j, and of products, around the means.
PARTS = ("n", "mean_i", "mean_j", "square_i", "square_j", "product")
STATE = "i int, " + ", ".join(f"{p} array<double>" for p in PARTS)
_CELLS = 1 << 21  # values of a batch that are multiplied at a time


def measure(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The state of some rows (rows x columns): parts x columns x columns."""
    counts = known.sum(axis=0)
    shift = np.where(known, values, 0.0).sum(axis=0) / np.maximum(counts, 1)
    x = np.where(known, values - shift, 0.0)
    ones = known.astype(np.float64)
    n = ones.T @ ones
    total = x.T @ ones
    mean = total / np.maximum(n, 1.0)
    square = (x * x).T @ ones - total * mean
    product = x.T @ x - total * mean.T
    place = np.where(n > 0, mean + shift[:, None], 0.0)
    return np.stack([n, place, place.T, np.maximum(square, 0.0), np.maximum(square.T, 0.0), product])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the rows of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    d_i = np.where(a[0] > 0, b[1] - a[1], 0.0) * (b[0] > 0)
    d_j = np.where(a[0] > 0, b[2] - a[2], 0.0) * (b[0] > 0)
    weight = a[0] * share
    return np.stack([
        n, np.where(a[0] > 0, a[1] + d_i * share, b[1]), np.where(a[0] > 0, a[2] + d_j * share, b[2]),
        a[3] + b[3] + d_i * d_i * weight, a[4] + b[4] + d_j * d_j * weight,
        a[5] + b[5] + d_i * d_j * weight])


def _rows(state: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i, parts in sorted(state.items()):
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), *[pa.array([list(p)], pa.list_(pa.float64())) for p in parts]],
            names=["i", *PARTS])


def gram(df: DataFrame, columns, null_as_zero: bool = False) -> DataFrame:
    """One row for each column: its number ``i`` and the arrays of STATE over all columns."""
    columns = names(columns)
    check_columns(df, columns)
    inputs = df.select([
        (F.coalesce(col(c).cast("double"), F.lit(0.0)) if null_as_zero else col(c).cast("double"))
        .alias(f"_x{i}") for i, c in enumerate(columns)])
    width = len(columns)

    def summed(batches):
        total = None
        step = max(1, _CELLS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False)
                                         for c in part.columns])
                values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False)
                                          for c in part.columns])
                found = measure(values, known)
                total = found if total is None else merge(total, found)
        if total is not None:
            yield from _rows({i: total[:, i] for i in range(width)})

    def merged(batches):
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                found = np.array([row[p] for p in PARTS])
                old = state.get(row["i"])
                state[row["i"]] = found if old is None else merge(old, found)
        yield from _rows(state)
    return inputs.mapInArrow(summed, STATE).repartition("i").mapInArrow(merged, STATE)
