"""Isotonic regression over ranges: nothing is pooled in one place.

Equal features are averaged first, on the map side. The rest is sorted into ranges, and each range is
fitted by itself: neighbours whose means do not rise are pooled into blocks. Neighbouring ranges, then
pairs of ranges, and so on, are merged: where two fits meet, blocks are pooled as long as means do not
rise, from the last of the left one and the first of the right one. A merge reads blocks only as far
as it pools them, and leaves one record that stands for all of these. So the driver holds a record for
each range at most, and no task more than the blocks of its range.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import ranges
from millrace.util import check_columns, col, require, scratch

POINTS = "x double, total double, weight double, _part long, _pos long, block long"
BLOCKS = "block long, low double, high double, total double, weight double"
_ROWS = 1 << 16  # blocks that a merge reads at a time


class Block(NamedTuple):
    low: float
    high: float
    total: float
    weight: float

    def pooled(self, right: Block) -> Block:
        return Block(self.low, right.high, self.total + right.total, self.weight + right.weight)

    def violates(self, right: Block) -> bool:
        """Whether the mean does not rise from this block to the next."""
        return self.total * right.weight >= right.total * self.weight


def pool(points) -> list[tuple[Block, int]]:
    """Blocks of rising means, each with the number of points in it, from points in order."""
    stack: list[tuple[Block, int]] = []
    for block in points:
        n = 1
        while stack and stack[-1][0].violates(block):
            left, m = stack.pop()
            block, n = left.pooled(block), n + m
        stack.append((block, n))
    return stack


def _fitted_range(batches) -> Iterator[pa.RecordBatch]:
    """Add the number of its block to every point of a range."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    x, total, weight = (table.column(c).to_numpy() for c in ("x", "total", "weight"))
    blocks = pool(Block(a, a, t, w) for a, t, w in zip(x.tolist(), total.tolist(), weight.tolist()))
    number = np.repeat(np.arange(len(blocks)), [n for _, n in blocks])
    yield from table.append_column("block", pa.array(number, pa.int64())).to_batches(_ROWS)


class _Stored:
    """The blocks of ranges, read from either end, with pooled records in place of what they cover."""

    def __init__(self, path: str, pooled: list[Block]):
        self.path, self.pooled = path, sorted(pooled)
        self.lows = [b.low for b in self.pooled]

    def _chunks(self, part: int, backward: bool) -> Iterator[list[Block]]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(self.path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{root}/_part={part}"))
                       if f.path.endswith(".parquet"))
        for name in reversed(files) if backward else files:
            with system.open_input_file(name) as stream:
                file = pq.ParquetFile(stream)
                groups = range(file.num_row_groups)
                for group in reversed(groups) if backward else groups:
                    found = file.read_row_group(group, columns=list(Block._fields)).to_pydict()
                    rows = [Block(*r) for r in zip(*found.values())]
                    yield rows[::-1] if backward else rows

    def read(self, parts: list[int], backward: bool) -> Iterator[Block]:
        given = None
        for part in reversed(parts) if backward else parts:
            for rows in self._chunks(part, backward):
                for block in rows:
                    at = bisect.bisect_right(self.lows, block.low) - 1
                    cover = self.pooled[at] if at >= 0 and self.pooled[at].high >= block.high else None
                    if cover is None:
                        yield block
                    elif cover != given:
                        given = cover
                        yield cover


def junction(left: Iterator[Block], right: Iterator[Block]) -> Block | None:
    """What is pooled where two fits meet: ``left`` from its end, ``right`` from its beginning."""
    a, b = next(left, None), next(right, None)
    if a is None or b is None or not a.violates(b):
        return None
    middle, a, b = a.pooled(b), next(left, None), next(right, None)
    while True:
        if a is not None and a.violates(middle):
            middle, a = a.pooled(middle), next(left, None)
        elif b is not None and middle.violates(b):
            middle, b = middle.pooled(b), next(right, None)
        else:
            return middle


def _outer(pooled: list[Block]) -> list[Block]:
    """The records that no other one covers."""
    out: list[Block] = []
    for block in sorted(pooled, key=lambda b: (b.low, -b.high)):
        if not out or block.high > out[-1].high:
            out.append(block)
    return out


class IsotonicRanges:
    """A fit: ``points`` (x, fitted) for every feature that occurs, and ``blocks`` (low, high,
    value, weight) of equal fitted values."""

    def __init__(self, points: DataFrame, blocks: DataFrame):
        self.points, self.blocks = points, blocks


def fit_ranges(df: DataFrame, feature: str, label: str, weight: str | None = None,
               rising: bool = True) -> IsotonicRanges:
    """Weighted least squares under the condition that fitted values do not fall (or rise).

    Rows without a feature, a label or a positive weight are left out.
    """
    check_columns(df, [feature, label, *([weight] if weight else [])])
    spark, sign = df.sparkSession, 1.0 if rising else -1.0
    w = col(weight).cast("double") if weight else F.lit(1.0)
    x, y = (F.nanvl(col(c).cast("double"), F.lit(None)) for c in (feature, label))
    sums = (df.select(x.alias("x"), (y * sign).alias("y"), w.alias("w"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") > 0))
            .groupBy("x").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight")))
    path = scratch(spark, "isotonic")
    (ranges(sums, ["x"]).mapInArrow(_fitted_range, POINTS).write.partitionBy("_part")
     .parquet(f"{path}/points"))
    points = spark.read.schema(POINTS).parquet(f"{path}/points")
    blocks = points.groupBy("_part", "block").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.sum("total").alias("total"),
        F.sum("weight").alias("weight"))
    (blocks.repartition("_part").sortWithinPartitions("_part", "block").write.partitionBy("_part")
     .option("parquet.block.size", 4 << 20).parquet(f"{path}/blocks"))
    stored = spark.read.schema(f"_part long, {BLOCKS}").parquet(f"{path}/blocks")
    parts = sorted(r["_part"] for r in stored.select("_part").distinct().collect())
    pooled = _merged(spark, f"{path}/blocks", parts)

    value = F.col("total") / F.col("weight") * sign
    # A record for each range at most.
    records = spark.createDataFrame(
        [(b.low, b.high, b.total, b.weight) for b in pooled],
        "_low double, _high double, _total double, _weight double")
    listed = F.array_sort(F.collect_list(F.struct("_low", "_high", "_total", "_weight")))
    covers = records.agg(listed.alias("r")).scalar()
    own = stored.withColumn("_r", covers).withColumn("_c", F.get(F.filter(
        "_r", lambda r: (r["_low"] <= F.col("low")) & (F.col("high") <= r["_high"])), F.lit(0)))
    fitted = F.coalesce(F.col("_c._total") / F.col("_c._weight") * sign, value)
    marked = own.select("_part", "block", "low", "high", "weight", "_c", fitted.alias("value"))
    kept = marked.where(F.col("_c").isNull()).select("low", "high", "value", "weight")
    pools = records.select(F.col("_low").alias("low"), F.col("_high").alias("high"),
                           (F.col("_total") / F.col("_weight") * sign).alias("value"),
                           F.col("_weight").alias("weight"))
    found = points.select("_part", "block", "x").join(
        marked.select("_part", "block", "value"), ["_part", "block"])
    return IsotonicRanges(found.select("x", F.col("value").alias("fitted")), kept.unionByName(pools))


def _merged(spark, path: str, parts: list[int]) -> list[Block]:
    """The pooled records after all neighbours were merged, level by level."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    full = full.replace("file:/", "file:///", 1) if not full.startswith("file://") else full
    groups, pooled = [[p] for p in parts], []
    while len(groups) > 1:
        pairs = list(zip(groups[::2], groups[1::2]))

        def merge(batches, known=tuple(pooled)):
            stored = _Stored(full, list(known))
            for batch in batches:
                for left, right in zip(*(c.to_pylist() for c in batch.columns)):
                    found = junction(stored.read(left, True), stored.read(right, False))
                    if found is not None:
                        yield pa.RecordBatch.from_pylist([found._asdict()])
        tasks = spark.createDataFrame(pairs, "a array<long>, b array<long>").repartition(len(pairs))
        found = tasks.mapInArrow(merge, "low double, high double, total double, weight double").collect()
        pooled = _outer([*pooled, *[Block(*r) for r in found]])
        groups = [a + b for a, b in pairs] + (groups[-1:] if len(groups) % 2 else [])
    return pooled


def isotonic_fitted(df: DataFrame, feature: str, label: str, out: str = "fitted",
                    weight: str | None = None, rising: bool = True) -> DataFrame:
    """The rows with their fitted values; NULL without a feature."""
    require(out not in df.columns, f"column {out} exists already")
    points = fit_ranges(df, feature, label, weight, rising).points.toDF("_x", "_fitted")
    return df.join(points, col(feature).cast("double") == F.col("_x"), "left").select(
        *[col(c) for c in df.columns], F.col("_fitted").alias(out))
