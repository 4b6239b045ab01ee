"""Operators that depend on a total order, without a one-task global sort.

The frame is range-partitioned and sorted, and written once to shared scratch
space together with each row's partition and position, and with running sums
that the writing pass carries along. The per-partition totals (one row per
partition) then turn local positions and sums into global ones. What was written does not change, so a task that runs again after
an executor was lost gives the same rows the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.relational import join, sort_columns, sort_names
from millrace.util import check_columns, col, pairs, require, row_hash, written

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def ranges(df: DataFrame, order_by) -> DataFrame:
    """The frame in sorted ranges, with the number ``_part`` of each row's range and its place
    ``_pos`` there.

    The row hash and the input partition break ties, so that a value that
    fills a third of the table is spread over many range partitions.
    """
    keys = [*sort_columns(df, order_by), F.col("_tie"), F.col("_copy")]
    tagged = df.withColumns({"_tie": row_hash(df), "_copy": F.spark_partition_id()})
    sorted_ranges = tagged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = sorted_ranges.drop("_tie", "_copy").withColumn(
        "_place", F.monotonically_increasing_id())
    return (numbered.withColumn("_part", F.shiftright("_place", _LOCAL_BITS))
            .withColumn("_pos", F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
            .drop("_place"))


def _carried(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add ``_run_{output}``: the sum of the column from the start of the range to the row.

    The rows pass through the task once, in order, and each sum is carried from batch to batch.
    Missing values add nothing.
    """
    whole = {out: not isinstance(df.schema[source].dataType, (T.FloatType, T.DoubleType))
             for out, source in sums.items()}
    for source in sums.values():
        kind = df.schema[source].dataType
        require(isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType),
                f"running sums need whole or floating numbers, not {kind.simpleString()}")
    kinds = {out: "bigint" if w else "double" for out, w in whole.items()}
    inputs = df.withColumns({f"_run_{out}": F.coalesce(col(source).cast(kinds[out]),
                                                       F.lit(0).cast(kinds[out]))
                             for out, source in sums.items()})
    names = [f"_run_{out}" for out in sums]

    def run(batches):
        before = dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                at = batch.schema.get_field_index(name)
                values = batch.column(at).to_numpy(zero_copy_only=False)
                total = np.cumsum(values) + before[name]
                if len(total):
                    if total.dtype == np.int64 and abs(
                            float(before[name]) + values.astype(float).sum()) > 2.0 ** 63:
                        raise OverflowError("a running sum is too large for 64 bits")
                    before[name] = total[-1]
                batch = batch.set_column(at, name, pa.array(total))
            yield batch
    return inputs.mapInArrow(run, inputs.schema)


def _with_offsets(placed: DataFrame, totals: dict) -> DataFrame:
    """Add, per measure, the sum over earlier partitions and over all of them.

    ``totals`` gives the aggregate of a partition's rows that is its total.
    The broadcast side has one row per range partition, so its size is bounded
    by the number of shuffle partitions and not by the data.
    """
    per_part = placed.groupBy("_part").agg(*[t.alias(f"_sum_{n}") for n, t in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)
    offsets = per_part.select("_part", *[
        column for n in totals for column in (
            F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}"),
            F.sum(f"_sum_{n}").over(overall).alias(f"_all_{n}"))])
    return placed.join(F.broadcast(offsets), "_part")


def row_index(df: DataFrame, order_by, name: str = "index") -> DataFrame:
    """Add the gap-free position 0, 1, 2 … of each row in the given order."""
    require(name not in df.columns, f"column {name} exists already")
    placed = written(ranges(df, order_by), "ranges")
    counted = _with_offsets(placed, {"rows": F.count(F.lit(1))})
    return counted.select(*[col(c) for c in df.columns],
                          (F.col("_before_rows") + F.col("_pos")).alias(name))


def prefix_sums(df: DataFrame, order_by, sums, totals: bool = False) -> DataFrame:
    """Add running sums over the whole frame in the given order.

    ``sums`` maps an output name to the column to add up; ``totals`` adds the
    grand total of each as ``{output}_total``. A missing value adds nothing.
    """
    sums = dict(sums)
    check_columns(df, sums.values())
    placed = written(_carried(ranges(df, order_by), sums), "ranges")
    # The last row of a range has its total.
    joined = _with_offsets(placed, {out: F.max_by(f"_run_{out}", "_pos") for out in sums})
    outputs = []
    for out in sums:
        outputs.append((F.col(f"_run_{out}") + F.col(f"_before_{out}")).alias(out))
        if totals:
            outputs.append(F.col(f"_all_{out}").alias(f"{out}_total"))
    return joined.select(*[col(c) for c in df.columns], *outputs)


def zip_columns(left: DataFrame, right: DataFrame, left_order, right_order,
                left_cols=None, right_cols=None) -> DataFrame:
    """Put two frames side by side, row by row in their given orders.

    The shorter frame is filled up with NULLs.
    """
    index, sides = "_zip_row", []
    for df, order, columns in ((left, left_order, left_cols), (right, right_order, right_cols)):
        new_names = {c: c for c in df.columns} if columns is None else dict(pairs(columns))
        mapped = [(c, new_names[c]) for c in df.columns if c in new_names]
        needed = {c for c, _ in mapped} | set(sort_names(order))
        kept = df.select([col(c) for c in df.columns if c in needed])
        sides += [row_index(kept, order, index), mapped]
    a, a_cols, b, b_cols = sides
    return join(a, b, [(index, index)], "full", a_cols, b_cols)
