"""Reshaping: unpivot, per-feature pivot, explode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.relational import aggregate
from millrace.util import check_columns, col, fresh, names, quoted, same_type


def unpivot(df: DataFrame, columns, out: str, name_col: str | None = None) -> DataFrame:
    """Turn columns into rows in one scan: the other columns plus ``out``.

    ``name_col`` adds the name of the source column.
    """
    columns = names(columns)
    check_columns(df, columns)
    others = [c for c in df.columns if c not in columns]
    values = same_type(df, columns)
    prepared = df.select(*[col(c) for c in others],
                         *[v.alias(c) for v, c in zip(values, columns)])
    variable = name_col or fresh(df, "_variable")
    long = prepared.unpivot([col(c) for c in others], [col(c) for c in columns], variable, out)
    return long if name_col else long.drop(quoted(variable) if "." in variable else variable)


def feature_agg(df: DataFrame, features, pivot: str, values, column: str, fn: str) -> DataFrame:
    """For every feature column: group by it, pivot and aggregate.

    The results are stacked with the feature's value in ``encode_feature``. All
    features share one scan and one aggregation.
    """
    features = names(features)
    check_columns(df, [*features, pivot, column])
    prepared = df.select(
        *[v.alias(f"_f{i}") for i, v in enumerate(same_type(df, features))],
        col(pivot).alias("_pivot"), col(column).alias("_value"))
    long = prepared.unpivot(["_pivot", "_value"], [f"_f{i}" for i in range(len(features))],
                            "_feature", "encode_feature")
    return (long.groupBy("_feature", "encode_feature")
            .pivot("_pivot", list(values)).agg(aggregate(fn, "_value"))
            .drop("_feature"))


def explode(df: DataFrame, column: str, outer: bool = False) -> DataFrame:
    """Replace an array column by one row per element.

    Rows with a NULL or empty array disappear, unless ``outer`` is set.
    """
    check_columns(df, [column])
    blow_up = F.explode_outer if outer else F.explode
    return df.withColumn(column, blow_up(col(column)))
