"""Profiles as stored states that merge: parts are read once, whatever is asked of them together.

A state has one row per column: counts, range, mean, the sum of squares around the mean, and two
sketches of bounded size, HyperLogLog for distinct values and KLL for ranks. States of parts merge in
any order, and the profile of the whole follows from the merged state alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.profile import STATS_SCHEMA, kind_of, present
from millrace.util import check_columns, col, names, require

STATE = ("column string, kind string, rows bigint, present bigint, min double, max double, "
         "mean double, squares double, distinct binary, ranks binary")
_DISTINCT_BITS = 12   # 4,096 registers: a standard error of 1.6 %
_SHARES = 1_000
_RANK_SIZE = 400      # values that a KLL sketch keeps of a level: ranks within about 1 %


def profile_state(df: DataFrame, columns, by=()) -> DataFrame:
    """The state of each column, in one aggregation; with ``by``, of each group of the rows.

    Distinct values include the empty text; missing values (NULL, NaN, empty text) have no ranks.
    """
    columns, by = names(columns), list(by)
    check_columns(df, [*columns, *by])
    known = [(i, c) for i, c in enumerate(columns) if kind_of(df.schema[c].dataType)]
    require(bool(known), "no column can be profiled")
    inputs = df.select(*[col(c).alias(f"_b{i}") for i, c in enumerate(by)],
                       *[present(df, c).alias(f"_x{i}") for i, c in known],
                       *[(col(c) if isinstance(df.schema[c].dataType, T.StringType)
                          else present(df, c)).alias(f"_v{i}") for i, c in known])
    cells, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, name in known:
        kind, value, v = kind_of(df.schema[name].dataType), F.col(f"_x{i}"), F.col(f"_v{i}")
        hashed = F.when(v.isNotNull(), F.xxhash64(v))
        cells += [F.count(value).alias(f"_n{i}"),
                  F.hll_sketch_agg(hashed, _DISTINCT_BITS).alias(f"_d{i}")]
        spread = [F.lit(None)] * 5
        if kind == "numeric":
            number = value.cast("double")
            cells += [fn(number).alias(f"_{tag}{i}") for tag, fn in (
                ("min", F.min), ("max", F.max), ("mean", F.avg), ("var", F.var_pop))]
            cells.append(F.kll_sketch_agg_double(number, _RANK_SIZE).alias(f"_k{i}"))
            spread = [F.col(f"_min{i}"), F.col(f"_max{i}"), F.col(f"_mean{i}"),
                      F.col(f"_var{i}") * F.col(f"_n{i}"), F.col(f"_k{i}")]
        rows.append(F.struct(F.lit(name), F.lit(kind), F.col("_rows"), F.col(f"_n{i}"), *spread[:4],
                             F.col(f"_d{i}"), spread[4]).cast(T.StructType.fromDDL(STATE)))
    grouped = inputs.groupBy(*[f"_b{i}" for i in range(len(by))]).agg(*cells)
    return grouped.select(*[F.col(f"_b{i}").alias(c) for i, c in enumerate(by)],
                          F.inline(F.array(*rows)))


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from those of disjoint parts: a frame like ``profile_state``'s."""
    weight = F.col("mean") * F.col("present")
    means = states.groupBy("column").agg(
        F.try_divide(F.sum(weight), F.sum(F.when(F.col("mean").isNotNull(), F.col("present"))))
        .alias("_mean"))
    away = F.col("mean") - F.col("_mean")
    return states.join(means, "column").groupBy("column", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.first("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("present") * away * away).alias("squares"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks")).select(*T.StructType.fromDDL(STATE).names)


def state_stats(states: DataFrame) -> DataFrame:
    """The statistics of a merged state, in the columns of ``profile_stats``."""
    numeric = F.col("kind") == "numeric"
    variance = F.try_divide("squares", "present")
    return states.select(
        "column", "kind", F.when(numeric, F.col("present")).otherwise(F.col("rows")), "min", "max",
        "mean", F.sqrt(variance), variance, F.hll_sketch_estimate("distinct"),
        F.col("rows") - F.col("present")).toDF(*STATS_SCHEMA.names)


def state_quantiles(states: DataFrame, probabilities) -> DataFrame:
    """(``column``, ``quantile``, ``value``) of the numeric columns, from their ranks."""
    probabilities = [float(p) for p in probabilities]
    require(bool(probabilities) and all(0.0 <= p <= 1.0 for p in probabilities),
            "probabilities must be between 0 and 1")
    wanted = F.array(*[F.lit(p) for p in probabilities])
    known = states.where((F.col("kind") == "numeric") & (F.col("present") > 0))
    values = F.kll_sketch_get_quantile_double("ranks", wanted)
    return known.select("column", F.inline(F.arrays_zip(
        wanted.alias("quantile"), values.alias("value"))))


def state_ranges(states: DataFrame, buckets: int = 10) -> DataFrame:
    """(``column``, ``position``, ``low``, ``high``, ``y``): about how many values each of the even
    ranges holds; all but the last are open at their upper end."""
    require(buckets > 0, "the number of buckets must be positive")
    known = states.where((F.col("kind") == "numeric") & (F.col("present") > 0))
    width = (F.col("max") - F.col("min")) / F.lit(buckets)
    edges = F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda i: F.when(
        i == buckets, F.col("max")).otherwise(F.col("min") + i * width))
    # The sketch is asked for fixed shares only: a rank is the part of them that lies below.
    shares = F.array(*[F.lit(i / _SHARES) for i in range(_SHARES + 1)])
    spread = known.withColumns({"edges": edges, "values": F.kll_sketch_get_quantile_double(
        "ranks", shares)}).withColumn("upto", F.transform("edges", lambda edge, i: F.when(
            i == buckets - 1, F.lit(1.0)).otherwise(F.size(F.filter(
                "values", lambda v: v < edge)) / F.lit(float(_SHARES + 1)))))
    return spread.select(
        "column", "min", "present", "edges", "upto", F.posexplode("edges").alias("position", "high")
    ).select(
        "column", "position", F.coalesce(F.get("edges", F.col("position") - 1), F.col("min"))
        .alias("low"), "high", F.round(F.col("present") * (F.get("upto", F.col("position")) - F.coalesce(
            F.get("upto", F.col("position") - 1), F.lit(0.0)))).cast("bigint").alias("y"))
