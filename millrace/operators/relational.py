"""Operators over whole frames: join, union, distinct, group, sort, free SQL."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import select_as
from millrace.operators.hotjoin import hot_join
from millrace.util import check_columns, col, fresh, names, pairs, quoted, require, salt

JOIN_TYPES = {
    "inner": "inner",
    "cross": "cross",
    "outer": "full", "full": "full", "fullouter": "full", "full_outer": "full",
    "left": "left", "leftouter": "left", "left_outer": "left",
    "right": "right", "rightouter": "right", "right_outer": "right",
    "semi": "left_semi", "leftsemi": "left_semi", "left_semi": "left_semi",
    "anti": "left_anti", "leftanti": "left_anti", "left_anti": "left_anti",
}

# Strategies that hold for sides of any size. Broadcasting is left to Spark, which
# compares the side with spark.sql.autoBroadcastJoinThreshold, before and at run time.
JOIN_HINTS = ("merge", "shuffle_hash")


def join(left: DataFrame, right: DataFrame, on=(), how: str = "inner",
         left_cols=None, right_cols=None, hint: str | None = None,
         salts: int | None = None, spread_hot: bool = False) -> DataFrame:
    """Equi-join two frames.

    ``left_cols`` and ``right_cols`` are ordered pairs (name, new name); they
    name the output columns, left ones first, and default to all columns.
    ``on`` holds pairs of new names, or text ``"a == b"``; a column that is not
    renamed may be used as well. NULL keys never match.

    Spark chooses the strategy: it broadcasts a side whose size it has checked,
    and its adaptive skew handling splits hot partitions. ``hint`` asks for one
    of the strategies that work at any size. ``salts`` spreads the rows of the
    preserved side (the left one for inner joins) over that many buckets per
    key and copies the other side once per bucket; use it where the adaptive
    split does not apply, as in full joins or below a grouping on the join key.
    ``spread_hot`` finds the hot keys of both sides by itself, in any kind of join, and
    moves only their rows more than once (``operators.hotjoin``).
    """
    require(not (salts and spread_hot), "choose salts or spread_hot")
    require(hint is None or hint in JOIN_HINTS, f"{hint} is not one of {', '.join(JOIN_HINTS)}")
    require(how.lower() in JOIN_TYPES, f"unknown join type: {how}")
    how = JOIN_TYPES[how.lower()]
    on = [_key_pair(item) for item in ([on] if isinstance(on, str) else on)]
    require(bool(on) or how == "cross", "a join needs at least one pair of keys")
    left, left_out, left_keys = _side(left, left_cols, [a for a, _ in on], "l")
    right, right_out, right_keys = _side(right, right_cols, [b for _, b in on], "r")
    output = left_out if how in ("left_semi", "left_anti") else left_out + right_out

    if spread_hot and how != "cross":
        joined = hot_join(left, right, left_keys, right_keys, how, hint)
    elif salts and how == "full":
        joined = _salted_full(left, right, left_keys, right_keys, salts, hint)
    elif salts and how != "cross":
        joined = _salted(left, right, left_keys, right_keys, how, salts, hint)
    else:
        joined = _plain(left, right, left_keys, right_keys, how, hint)
    return joined.select([F.col(inner).alias(outer) for inner, outer in output])


def _key_pair(item) -> tuple[str, str]:
    parts = [p.strip() for p in item.split("==")] if isinstance(item, str) else list(item)
    require(len(parts) == 2 and all(parts), f"{item} is not a pair of join columns")
    return parts[0], parts[1]


def _side(df: DataFrame, columns, keys: list[str], tag: str):
    """Give one side private names and keep only what the join needs."""
    columns = [(c, c) for c in df.columns] if columns is None else pairs(columns)
    check_columns(df, [old for old, _ in columns])
    renamed = {new: old for old, new in columns}
    moved = {old for old, _ in columns}
    output = [(f"_{tag}{i}", new) for i, (_, new) in enumerate(columns)]
    selected = [col(old).alias(inner) for (old, _), (inner, _) in zip(columns, output)]
    inner_keys = []
    for i, key in enumerate(keys):
        source = renamed.get(key)
        if source is None:
            require(key in df.columns and key not in moved, f"no such join column: {key}")
            source = key
        inner_keys.append(f"_{tag}k{i}")
        selected.append(col(source).alias(inner_keys[-1]))
    return df.select(selected), output, inner_keys


def _on(left_keys, right_keys) -> list[Column]:
    return [F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys)]


def _plain(left, right, left_keys, right_keys, how, hint=None) -> DataFrame:
    if hint:
        right = right.hint(hint)
    if how == "cross" and not left_keys:
        return left.crossJoin(right)
    return left.join(right, _on(left_keys, right_keys), "inner" if how == "cross" else how)


def _salted(left, right, left_keys, right_keys, how, salts, hint=None) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    if how == "right":
        left = left.withColumn("_ls", copies)
        right = right.withColumn("_rs", salt(right, salts))
    else:
        left = left.withColumn("_ls", salt(left, salts))
        right = right.withColumn("_rs", copies)
    # Spark takes the copies for one row each, and would broadcast a side ``salts`` times too large.
    return _plain(left, right, [*left_keys, "_ls"], [*right_keys, "_rs"], how, hint or "merge")


def _salted_full(left, right, left_keys, right_keys, salts, hint=None) -> DataFrame:
    kept_left = _salted(left, right, left_keys, right_keys, "left", salts, hint)
    seen = left.select(left_keys).distinct()
    only_right = right.join(seen, _on(left_keys, right_keys), "left_anti")
    return kept_left.unionByName(only_right, allowMissingColumns=True)


def union_rows(left: DataFrame, right: DataFrame, left_cols=None, right_cols=None) -> DataFrame:
    """Stack two frames by position, keeping duplicates.

    The frame with more columns comes first and gives the names; the other one
    is filled up on its right with NULLs. Where text meets another type, both
    become text.
    """
    left = left if left_cols is None else select_as(left, left_cols)
    right = right if right_cols is None else select_as(right, right_cols)
    wide, narrow = (left, right) if len(left.columns) >= len(right.columns) else (right, left)
    missing = wide.schema.fields[len(narrow.columns):]
    mixed = [isinstance(a.dataType, T.StringType) != isinstance(b.dataType, T.StringType)
             for a, b in zip(wide.schema, narrow.schema)]

    def aligned(df):
        flags = mixed + [False] * len(df.columns)
        return [col(c).cast("string").alias(c) if flag else col(c)
                for c, flag in zip(df.columns, flags)]
    padding = [F.lit(None).cast(f.dataType).alias(f.name) for f in missing]
    return wide.select(aligned(wide)).union(narrow.select(aligned(narrow) + padding))


def distinct(df: DataFrame, columns, order_by=None) -> DataFrame:
    """Keep one row per key: any row, or the first one in the order ``order_by``.

    Both forms cut each key down to one row per map task before the shuffle,
    so a key that holds most of the table is harmless.
    """
    columns = names(columns)
    check_columns(df, columns)
    if order_by is None:
        return df.dropDuplicates(columns)
    rank = fresh(df, "_rank")
    window = Window.partitionBy(*[col(c) for c in columns]).orderBy(*sort_columns(df, order_by))
    return (df.withColumn(rank, F.row_number().over(window))
            .where(F.col(rank) == 1).drop(rank))


# Names that Spark's grouped aggregation by name accepts besides registered functions.
_AGGREGATE_SYNONYMS = {"average": "avg", "size": "count"}


def aggregate(fn: str, column: str) -> Column:
    """An aggregate by name; ``*`` counts rows."""
    if column == "*":
        require(fn.lower() in ("count", "size"), f"{fn} cannot take *")
        return F.count(F.lit(1))
    if fn.lower() in ("count_distinct", "countdistinct"):
        return F.count_distinct(col(column))
    return F.call_function(_AGGREGATE_SYNONYMS.get(fn.lower(), fn), col(column))


def group_agg(df: DataFrame, keys, aggs) -> DataFrame:
    """Group and aggregate.

    ``aggs`` holds (column, function) or (column, function, name); the name
    defaults to ``{column}_{function}``.
    """
    keys = names(keys)
    check_columns(df, keys)
    outputs = []
    for item in pairs(aggs):
        column, fn = item[:2]
        default = fn if column == "*" else f"{column}_{fn}"
        outputs.append(aggregate(fn, column).alias(item[2] if len(item) > 2 else default))
    require(bool(outputs), "at least one aggregate is needed")
    return df.groupBy(*[col(k) for k in keys]).agg(*outputs)


def pivot_agg(df: DataFrame, keys, pivot: str, values, column: str, fn: str) -> DataFrame:
    """Group by the keys and give each listed pivot value its own column."""
    keys = names(keys)
    check_columns(df, [*keys, pivot])
    grouped = df.groupBy(*[col(k) for k in keys])
    return grouped.pivot(quoted(pivot), list(values)).agg(aggregate(fn, column))


def _sort_items(columns) -> list[tuple[str, str]]:
    if isinstance(columns, str):
        columns = [columns]
    items = columns.items() if isinstance(columns, Mapping) else columns
    return [(item, "asc") if isinstance(item, str) else tuple(item) for item in items]


def sort_names(columns) -> list[str]:
    """The column names of a sort order."""
    return [name for name, _ in _sort_items(columns)]


def sort_columns(df: DataFrame, columns) -> list[Column]:
    """Sort expressions from names or (name, rule) pairs.

    A rule is asc or desc, optionally followed by _nulls_first or _nulls_last.
    """
    out = []
    for name, rule in _sort_items(columns):
        check_columns(df, [name])
        require(re.fullmatch(r"(asc|desc)(_nulls_(first|last))?", rule) is not None,
                f"{rule} is not a sorting rule for column {name}")
        out.append(getattr(col(name), rule)())
    require(bool(out), "at least one column is needed")
    return out


def order_by(df: DataFrame, columns, limit: int | None = None) -> DataFrame:
    """Sort; with ``limit`` Spark keeps only the top rows of every task."""
    ordered = df.orderBy(*sort_columns(df, columns))
    return ordered if limit is None else ordered.limit(limit)


def sql_query(sql: str, *dfs: DataFrame) -> DataFrame:
    """Run Spark SQL in which ``{0}``, ``{1}`` … stand for the given frames.

    Other braces, as in patterns or JSON text, are left alone.
    """
    require(bool(dfs), "at least one frame is needed")
    used = {f"in{i}": df for i, df in enumerate(dfs) if "{" + str(i) + "}" in sql}
    if not used:
        return dfs[0].sparkSession.sql(sql)
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in used:
        text = text.replace("{{" + name.removeprefix("in") + "}}", "{" + name + "}")
    return dfs[0].sparkSession.sql(text, **used)
