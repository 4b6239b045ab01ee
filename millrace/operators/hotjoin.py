"""Joins in which any key of any side may be hot.

A bounded summary of each side names the keys that could hold more than their share of it; these are
counted, and only they are spread. A hot key becomes a grid: its left rows are dealt to the grid's
rows, its right rows to the columns, and every cell meets one fragment of each side. A left row is
sent to all cells of its row, a right row to all cells of its column, so every pair meets in exactly
one cell. All other rows are moved once, as in a plain join, and both inputs are read once by the join
itself (the summary and the counts read their key columns only).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.util import require, row_hash

_SUPPORT = 1e-4  # Spark's summary of frequent items knows no smaller share
_PIECES = 8      # fragments for each average partition that a hot key would fill


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _typed(left: DataFrame, right: DataFrame, left_keys, right_keys):
    """Both sides with keys of common types; floating zeros and NaNs of one form each."""
    a, b = [[df.schema[k].dataType for k in keys]
            for df, keys in ((left, left_keys), (right, right_keys))]
    for x, y in zip(a, b):
        require(x == y or isinstance(x, T.NumericType) and isinstance(y, T.NumericType),
                f"keys of the types {x.simpleString()} and {y.simpleString()} cannot be spread")
    none = [df.select([F.col(k) for k in keys]).limit(0)
            for df, keys in ((left, left_keys), (right, right_keys))]
    common = [f.dataType for f in none[0].union(none[1]).schema]

    def same(key: str, kind: T.DataType) -> Column:
        value = F.col(key).cast(kind)
        return value + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value
    return [df.withColumns({k: same(k, kind) for k, kind in zip(keys, common)})
            for df, keys in ((left, left_keys), (right, right_keys))]


def _hash(keys) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _candidates(df: DataFrame, keys, support: float) -> list[int]:
    """Hashes of all keys that hold more than ``support`` of the rows; at most 1 / support."""
    hashed = df.dropna(subset=list(keys)).select(_hash(keys).alias("h"))
    return list(hashed.freqItems(["h"], support).first()[0] or [])


def _counted(df: DataFrame, keys, hashes: list[int], side: str) -> DataFrame:
    """The rows of each key among the hashes, and of all other keys together."""
    known = df.dropna(subset=list(keys)).withColumn("_hot", _hash(keys).isin(hashes))
    named = known.select("_hot", *[F.when(F.col("_hot"), F.col(k)).alias(f"_h{i}")
                                   for i, k in enumerate(keys)])
    counts = [F.count(F.lit(1)) if s == side else F.lit(0).cast("bigint") for s in ("l", "r")]
    return named.groupBy(*named.columns).agg(counts[0].alias("_nl"), counts[1].alias("_nr"))


def grid(n_left: int, n_right: int, all_left: int, all_right: int, partitions: int
         ) -> tuple[int, int]:
    """Rows and columns of a key's grid.

    Fragments are an eighth of an average partition. Where both sides are hot, there are at most
    64 cells for each partition, which bounds how often a row is sent.
    """
    a = min(max(n_left, 1), math.ceil(_PIECES * partitions * n_left / max(all_left, 1)) or 1)
    b = min(max(n_right, 1), math.ceil(_PIECES * partitions * n_right / max(all_right, 1)) or 1)
    most = _PIECES * _PIECES * partitions
    if a * b > most:
        scale = math.sqrt(most / (a * b))
        a, b = max(1, math.floor(a * scale)), max(1, math.floor(b * scale))
    return a, b


def hot_keys(left: DataFrame, right: DataFrame, left_keys, right_keys) -> list[tuple]:
    """(key, rows of the grid, columns, whether both sides have the key) of the hot keys.

    A key is hot if it holds more than half an average partition of a side, or a ten-thousandth of
    it where there are more than 5,000 partitions: so many keys at most, whatever the input.
    """
    n = _partitions(left)
    support = max(_SUPPORT, 1 / (2 * n))
    hashes = sorted({*_candidates(left, left_keys, support), *_candidates(right, right_keys, support)})
    if not hashes:
        return []
    both = _counted(left, left_keys, hashes, "l").union(_counted(right, right_keys, hashes, "r"))
    names = ["_hot", *[f"_h{i}" for i in range(len(left_keys))]]
    # One row per candidate, and one for all other keys.
    rows = both.groupBy(*names).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr")).collect()
    all_left, all_right = sum(r["_nl"] for r in rows), sum(r["_nr"] for r in rows)
    out = []
    for r in rows:
        a, b = r["_nl"], r["_nr"]
        if r["_hot"] and (a > support * all_left or b > support * all_right):
            out.append((tuple(r[c] for c in names[1:]), *grid(a, b, all_left, all_right, n),
                        a > 0 and b > 0))
    return out


def _dealt(df: DataFrame, keys, hot: list[tuple], side: str) -> DataFrame:
    """Add ``_{side}c``, the cell, once for each cell the row is sent to, and ``_{side}b``: whether
    the other side surely has the key."""
    kinds = [df.schema[k].dataType for k in keys]
    schema = T.StructType([T.StructField(f"_h{i}", k) for i, k in enumerate(kinds)]
                          + [T.StructField("_rows", T.IntegerType()),
                             T.StructField("_cols", T.IntegerType()),
                             T.StructField(f"_{side}b", T.BooleanType())])
    # As many rows as there are hot keys, which the summary bounds.
    listed = F.broadcast(df.sparkSession.createDataFrame(
        [(*key, rows, cols, both) for key, rows, cols, both in hot], schema))
    same = [F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)]
    # The row hash parts rows of one key. Exact copies are parted by their input partitions, so a
    # fragment has no more of them than one input partition; both are the same on every attempt.
    drawn = F.xxhash64(row_hash(df), F.spark_partition_id())
    met = df.withColumn("_drawn", drawn).join(listed, same, "left")
    rows, cols = F.col("_rows"), F.col("_cols")
    if side == "l":
        own = F.pmod("_drawn", rows.cast("bigint")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), cols - 1), lambda c: own * cols + c)
    else:
        own = F.pmod("_drawn", cols.cast("bigint")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: r * cols + own)
    # A key with a NULL meets nothing, so its rows may go anywhere.
    anywhere = F.pmod("_drawn", F.lit(_PIECES * _partitions(df))).cast("int")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    sent = F.when(rows.isNotNull(), cells).when(missing, F.array(anywhere)).otherwise(
        F.array(F.lit(0)))
    return met.withColumn(f"_{side}c", F.explode(sent)).drop(
        "_drawn", "_rows", "_cols", *[f"_h{i}" for i in range(len(keys))])


def hot_join(left: DataFrame, right: DataFrame, left_keys, right_keys, how: str,
             hint: str | None = None) -> DataFrame:
    """Join by equal keys; see the module. The inputs must give the same rows when read again."""
    left, right = _typed(left, right, left_keys, right_keys)
    if how in ("left_semi", "left_anti"):
        # A semi-join asks only whether a key is there: one row of it will do.
        right = right.select([F.col(k) for k in right_keys]).distinct()
    hot = hot_keys(left, right, left_keys, right_keys)
    a = _dealt(left, left_keys, hot, "l").withColumn("_lm", F.lit(1))
    b = _dealt(right, right_keys, hot, "r").withColumn("_rm", F.lit(1))
    on = [F.col(x) == F.col(y) for x, y in zip([*left_keys, "_lc"], [*right_keys, "_rc"])]
    joined = a.join(b.hint(hint) if hint else b, on, how)
    # Where both sides have a hot key, each of its rows is matched in some cell: what a cell leaves
    # unmatched is no result.
    if how in ("left", "full"):
        joined = joined.where(~(F.coalesce("_lb", F.lit(False)) & F.col("_rm").isNull()))
    if how in ("right", "full"):
        joined = joined.where(~(F.coalesce("_rb", F.lit(False)) & F.col("_lm").isNull()))
    return joined
