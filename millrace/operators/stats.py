"""Column statistics: correlation, covariance, description, quantiles, frequent items."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.gram import PARTS, gram
from millrace.operators.ordering import prefix_sums
from millrace.operators.reshape import unpivot
from millrace.util import check_columns, col, names, require


# From so many columns on, one aggregate for each pair makes a plan that takes long to build.
_WIDE = 33


def _pair_matrix(df: DataFrame, columns, pair: Callable[[Column, Column], Column],
                 diagonal: Callable[[Column], Column], null_as_zero: bool) -> DataFrame:
    """All pairs in one aggregation, laid out as a symmetric matrix."""
    columns = names(columns)
    check_columns(df, columns)
    inputs = df.select([
        (F.coalesce(col(c).cast("double"), F.lit(0.0)) if null_as_zero
         else col(c).cast("double")).alias(f"_x{i}") for i, c in enumerate(columns)])
    cells = {}
    for i in range(len(columns)):
        cells[i, i] = diagonal(F.col(f"_x{i}"))
        for j in range(i + 1, len(columns)):
            cells[i, j] = pair(F.col(f"_x{i}"), F.col(f"_x{j}"))
    one_row = inputs.agg(*[cell.alias(f"_{i}_{j}") for (i, j), cell in cells.items()])
    rows = F.array(*[
        F.struct(F.lit(c).alias("Columns"), *[
            F.col(f"_{min(i, j)}_{max(i, j)}").alias(other) for j, other in enumerate(columns)])
        for i, c in enumerate(columns)])
    return one_row.select(F.inline(rows))


def _wide_matrix(df: DataFrame, columns, cell: Callable[[Column, Column], Column],
                 diagonal: float | None, null_as_zero: bool) -> DataFrame:
    """All pairs from one pass and one small plan, whatever the width; laid out as a matrix.

    ``cell`` makes a value of the state of a pair (see ``gram``), given the numbers of its columns.
    """
    columns = names(columns)
    states = gram(df, columns, null_as_zero)
    joined = F.arrays_zip(*PARTS)
    cells = states.select("i", F.transform(joined, lambda state, j: cell(state, F.col("i") == j))
                          .alias("cells"))
    # A frame without rows has no states, but a matrix all the same, with the given diagonal.
    listed = df.sparkSession.createDataFrame(list(enumerate(columns)), "i int, Columns string")
    return listed.join(cells, "i", "left").select("Columns", *[
        F.coalesce(F.get("cells", F.lit(j)), F.when(F.col("i") == j, F.lit(diagonal)).cast("double"))
        .alias(c) for j, c in enumerate(columns)])


def corr_matrix(df: DataFrame, columns, null_as_zero: bool = False) -> DataFrame:
    """Pearson correlations: ``Columns`` and one column per input.

    Pairs with a NULL are skipped, or read as 0 with ``null_as_zero``. Few columns are pairs of
    built-in aggregates; many are sums of products in blocks (``operators.gram``). Both read the
    input once.
    """
    if len(names(columns)) < _WIDE:
        return _pair_matrix(df, columns, F.corr, lambda c: F.lit(1.0), null_as_zero)

    def cell(state, same):
        spread = F.sqrt(state["square_i"] * state["square_j"])
        found = F.when(state["n"] > 1, F.try_divide(state["product"], spread))
        return F.when(same, F.lit(1.0)).otherwise(found)
    return _wide_matrix(df, columns, cell, 1.0, null_as_zero)


def cov_matrix(df: DataFrame, columns, null_as_zero: bool = False) -> DataFrame:
    """Sample covariances, with the variances on the diagonal; see ``corr_matrix``."""
    if len(names(columns)) < _WIDE:
        return _pair_matrix(df, columns, F.covar_samp, lambda c: F.covar_samp(c, c), null_as_zero)
    return _wide_matrix(df, columns, lambda state, same: F.when(
        state["n"] > 1, state["product"] / (state["n"] - 1)), None, null_as_zero)


def describe(df: DataFrame, columns) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum as text."""
    columns = names(columns)
    check_columns(df, columns)
    safe = df.select([col(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    described = safe.describe(*safe.columns)
    return described.select("summary", *[F.col(f"_x{i}").alias(c) for i, c in enumerate(columns)])


def quantiles(df: DataFrame, columns, probabilities, error: float = 0.0) -> DataFrame:
    """One row per probability: ``quantiles`` and the value of each column.

    NULL and NaN are left out. With an error above 0 a sketch of that relative
    error is used, one aggregation for all columns. With 0 the result is exact:
    a sketch narrows each quantile down to a few values, and only these are
    counted and ordered; no task sees a whole column.
    """
    columns = names(columns)
    check_columns(df, columns)
    probabilities = [float(p) for p in probabilities]
    require(bool(probabilities) and all(0.0 <= p <= 1.0 for p in probabilities),
            "probabilities must be between 0 and 1")
    require(0.0 <= error <= 1.0, "the error must be between 0 and 1")
    numbers = df.select([F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}")
                         for i, c in enumerate(columns)])
    if error > 0:
        return _sketched(numbers, columns, probabilities, error)
    return _exact(numbers, columns, probabilities)


def _sketched(numbers, columns, probabilities, error) -> DataFrame:
    accuracy = min(2**31 - 1, max(1, round(1.0 / error)))
    wanted = F.array(*[F.lit(p) for p in probabilities])
    one_row = numbers.agg(*[F.percentile_approx(c, wanted, F.lit(accuracy)).alias(c)
                            for c in numbers.columns])
    rows = F.array(*[
        F.struct(F.lit(p).alias("quantiles"), *[
            F.get(F.col(f"_x{j}"), F.lit(i)).alias(c) for j, c in enumerate(columns)])
        for i, p in enumerate(probabilities)])
    return one_row.select(F.inline(rows))


# The sketch that narrows exact quantiles down, and how far around a quantile
# its values are kept: twice the error of the sketch.
_SKETCH_ACCURACY = 10_000
_MARGIN = 2.0 / _SKETCH_ACCURACY


def _exact(numbers, columns, probabilities) -> DataFrame:
    found = _ranked(numbers, probabilities, _bands(numbers, probabilities))
    if any(cell["gap"] for row in found.values() for cell in row):
        # The sketch was further off than it should be: order all values.
        found = _ranked(numbers, probabilities, {})
    none = [{"v": None}] * len(probabilities)
    rows = [(p, *[found.get(x, none)[i]["v"] for x in numbers.columns])
            for i, p in enumerate(probabilities)]
    schema = "quantiles double" + "".join(f", {x} double" for x in numbers.columns)
    return numbers.sparkSession.createDataFrame(rows, schema).toDF("quantiles", *columns)


def _bands(numbers, probabilities) -> dict[str, list[tuple[float, float]]]:
    """Per column, disjoint rising ranges of values that should hold the quantiles."""
    lows = [max(p - _MARGIN, 0.0) for p in probabilities]
    highs = [min(p + _MARGIN, 1.0) for p in probabilities]
    edges = F.array(*[F.lit(e) for e in lows + highs])
    sketch = numbers.agg(*[F.percentile_approx(c, edges, F.lit(_SKETCH_ACCURACY)).alias(c)
                           for c in numbers.columns]).first()
    bands = {}
    for column, values in sketch.asDict().items():
        if values is None:
            continue
        open_low = [v if e > 0.0 else -math.inf for v, e in zip(values, lows)]
        open_high = [v if e < 1.0 else math.inf for v, e in zip(values[len(lows):], highs)]
        merged: list[tuple[float, float]] = []
        for low, high in sorted(zip(open_low, open_high)):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        bands[column] = merged
    return bands


def _ranked(numbers, probabilities, bands) -> dict[str, list]:
    """Per column, the value at each quantile's rank, and whether it is a gap.

    A value outside the bands is counted under the end of the band below it, as
    a gap, so that one aggregation has all ranks and few distinct values.
    """
    def place(x):
        def entry(value, gap):
            return F.struct(value.alias("v"), F.lit(gap).alias("gap"))
        value, out, below = F.col(x), None, -math.inf
        for low, high in bands.get(x, [(-math.inf, math.inf)]):
            step = F.when if out is None else out.when
            out = step(value < low, entry(F.lit(below), True)).when(
                value <= high, entry(value, False))
            below = high
        return out.when(value.isNotNull(), entry(F.lit(below), True))

    placed = unpivot(numbers.select([place(x).alias(x) for x in numbers.columns]),
                     numbers.columns, "_value", name_col="_column")
    counts = (placed.where(F.col("_value").isNotNull())
              .groupBy("_column", "_value.v", "_value.gap").agg(F.count(F.lit(1)).alias("_n")))
    summed = prefix_sums(counts, ["_column", "v", "gap"], {"_upto": "_n"})
    # One row per profiled column.
    spans = summed.groupBy("_column").agg(
        F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.max("_upto").alias("_end"))
    rank, size = F.col("_upto") - F.col("_start"), F.col("_end") - F.col("_start")

    def cell(p):
        target = F.greatest(size - F.floor(size - size * F.lit(p)), F.lit(1))
        return F.min(F.when(rank >= target, F.struct("v", "gap")))
    result = (summed.join(F.broadcast(spans), "_column").groupBy("_column")
              .agg(F.array(*[cell(p) for p in probabilities]).alias("cells")))
    return {row["_column"]: row["cells"] for row in result.collect()}


def freq_items(df: DataFrame, columns, support: float, exact: bool = False) -> DataFrame:
    """One row with an array ``{column}_freqItems`` per column.

    The default is a sketch that may include items below the support. With
    ``exact`` the items are counted; an array holds at most 1/support of them.
    """
    columns = names(columns)
    check_columns(df, columns)
    require(0.0 < support <= 1.0, "the support must be between 0 and 1")
    safe = df.select([col(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    if not exact:
        found = safe.freqItems(safe.columns, support)
        return found.select([F.col(f"_x{i}_freqItems").alias(f"{c}_freqItems")
                             for i, c in enumerate(columns)])
    text = safe.select([F.col(c).cast("string").alias(c) for c in safe.columns])
    counts = (unpivot(text, text.columns, "_value", name_col="_column")
              .groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("_n")))
    # One row per column.
    sizes = counts.groupBy("_column").agg(F.sum("_n").alias("_size"))
    frequent = (counts.join(F.broadcast(sizes), "_column")
                .where(F.col("_n") >= F.col("_size") * F.lit(float(support))))
    return frequent.agg(*[
        F.sort_array(F.collect_list(F.when(
            F.col("_column") == f"_x{i}", F.col("_value")).cast(df.schema[c].dataType)))
        .alias(f"{c}_freqItems") for i, c in enumerate(columns)])
