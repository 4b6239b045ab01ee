"""Column-level operators: select, rename, cast, derive, merge, split."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.util import check_columns, col, names, pairs, require


def select_as(df: DataFrame, columns) -> DataFrame:
    """Keep and rename the listed columns, in the order of the input.

    Names that the input lacks are ignored.
    """
    new_names = dict(pairs(columns))
    return df.select([col(c).alias(new_names[c]) for c in df.columns if c in new_names])


def rename(df: DataFrame, columns) -> DataFrame:
    """Rename the listed columns and keep all others."""
    new_names = dict(pairs(columns))
    return df.select([col(c).alias(new_names.get(c, c)) for c in df.columns])


def filter_all(df: DataFrame, conditions) -> DataFrame:
    """Keep the rows that meet every SQL predicate."""
    for condition in names(conditions):
        df = df.where(condition)
    return df


# What text must look like to have a chance of being read as the type. Testing
# it first is much cheaper than a failed conversion of every row.
_LOOKS_LIKE = [
    (T.IntegralType, r"^\s*[+-]?\d+(\.\d*)?\s*$"),
    (T.NumericType, r"\d|(?i:nan|inf)"),
    (T.DatetimeType, r"\d"),
]


def cast(df: DataFrame, types, strict: bool = False) -> DataFrame:
    """Cast columns to Spark types; a value that does not fit becomes NULL.

    Text with a fraction is cut to its whole part for integral targets. With
    ``strict`` a bad value raises instead.
    """
    wanted = dict(pairs(types))
    out = []
    for field in df.schema:
        source = col(field.name)
        target = wanted.get(field.name)
        if target is None:
            out.append(source)
        elif strict:
            out.append(source.cast(target).alias(field.name))
        else:
            if isinstance(field.dataType, T.StringType):
                source = _readable(source, target)
            out.append(source.try_cast(target).alias(field.name))
    return df.select(out)


def _readable(text: Column, target) -> Column:
    """The text, or NULL where it cannot be of the target type."""
    kind = T.DataType.fromDDL(target) if isinstance(target, str) else target
    for family, pattern in _LOOKS_LIKE:
        if isinstance(kind, family):
            if family is T.IntegralType:
                whole = F.when(text.contains("."), F.substring_index(text, ".", 1)).otherwise(text)
                return F.when(text.rlike(pattern), whole)
            return F.when(text.rlike(pattern), text)
    return text


def with_id(df: DataFrame, name: str) -> DataFrame:
    """Add a unique, increasing, non-consecutive id."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_lit(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column."""
    return df.withColumn(name, F.lit(value))


def with_expr(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column computed by any Spark SQL expression."""
    return df.withColumn(name, F.expr(expression))


def merge_cols(df: DataFrame, columns, out: str, sep: str, keep: bool = True) -> DataFrame:
    """Join columns into one text column; NULLs are left out."""
    columns = names(columns)
    check_columns(df, columns)
    merged = df.withColumn(out, F.concat_ws(sep, *[col(c) for c in columns]))
    if keep:
        return merged
    return merged.select([col(c) for c in merged.columns if c not in columns or c == out])


def split_col(df: DataFrame, column: str, sep: str, num: int | None = None,
              keep: bool = True) -> DataFrame:
    """Split text by a regular expression.

    With ``num`` the pieces become columns ``{column}_0`` …, NULL past the end;
    without it they become one array ``{column}_split``.
    """
    check_columns(df, [column])
    pieces = F.split(col(column), sep)
    if num is None:
        added = {f"{column}_split": pieces}
    else:
        added = {f"{column}_{i}": F.get(pieces, F.lit(i)) for i in range(num)}
    out = df.withColumns(added)
    if keep:
        return out
    return out.select([col(c) for c in out.columns if c != column])


def cache(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> DataFrame:
    """Mark the frame to be kept once it has been computed."""
    return df.persist(level)


def repartition(df: DataFrame, n: int, shuffle: bool = True) -> DataFrame:
    """Change the number of partitions, with or without a shuffle."""
    require(n > 0, "the number of partitions must be positive")
    return df.repartition(n) if shuffle else df.coalesce(n)
