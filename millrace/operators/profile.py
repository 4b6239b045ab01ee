"""Column profiles, previews and row counters."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.relational import sort_columns
from millrace.util import check_columns, col, names, require

_FLOATING = (T.FloatType, T.DoubleType)

STATS_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("stddev", T.DoubleType()),
    T.StructField("variance", T.DoubleType()),
    T.StructField("countdistinct", T.LongType()),
    T.StructField("countmissing", T.LongType()),
])

# Names and titles of the reported statistics, in report order.
NUMERIC_REPORT = [
    ("count", "Count"),
    ("min", "Min"),
    ("max", "Max"),
    ("mean", "Mean"),
    ("stddev", "Standard Deviation"),
    ("variance", "Variance"),
    ("countdistinct", "Unique Values"),
    ("countmissing", "Missing Values"),
]
TEXT_REPORT = [
    ("count", "Count"),
    ("countdistinct", "Unique Values"),
    ("countmissing", "Missing Values"),
]
KIND_TITLES = {"numeric": "Numeric Feature", "string": "String Feature"}


def kind_of(kind: T.DataType) -> str | None:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        return None
    return "string" if isinstance(kind, T.AtomicType) else None


def present(df: DataFrame, name: str) -> Column:
    """The value, or NULL where it is missing: NULL, NaN or empty text."""
    kind = df.schema[name].dataType
    if isinstance(kind, _FLOATING):
        return F.nanvl(col(name), F.lit(None).cast(kind))
    if isinstance(kind, T.StringType):
        return F.nullif(col(name), F.lit(""))
    return col(name)


def profile_stats(df: DataFrame, columns, exact: bool = False) -> DataFrame:
    """One row per column, from a single aggregation; exact distinct counts are a second one.

    Numeric columns have count (without missing values), range, mean,
    population deviation and variance; other columns have a count that
    includes missing values. Distinct counts are sketched unless ``exact``.
    """
    return _stats(df, columns, F.count_distinct if exact else F.approx_count_distinct)


def _stats(df: DataFrame, columns, count_distinct=None) -> DataFrame:
    """The statistics; without ``count_distinct`` their distinct counts are NULL."""
    columns = names(columns)
    check_columns(df, columns)
    profiled = [(i, c) for i, c in enumerate(columns) if kind_of(df.schema[c].dataType)]
    # Empty text is missing, yet a value of its own where distinct values are counted.
    inputs = df.select([present(df, c).alias(f"_x{i}") for i, c in profiled]
                       + [(col(c) if isinstance(df.schema[c].dataType, T.StringType)
                           else present(df, c)).alias(f"_v{i}") for i, c in profiled])
    cells, rows, sets = [F.count(F.lit(1)).alias("_rows")], [], []
    none = F.lit(None).cast("double")
    for i, name in profiled:
        kind = kind_of(df.schema[name].dataType)
        value = F.col(f"_x{i}")
        distinct = count_distinct(F.col(f"_v{i}")) if count_distinct else F.max(F.lit(None).cast("bigint"))
        cells.append(F.count(value).alias(f"_n{i}"))
        sets.append(distinct.alias(f"_d{i}"))
        filled, missing = F.col(f"_n{i}"), F.col("_rows") - F.col(f"_n{i}")
        if kind == "numeric":
            number = value.cast("double")
            for tag, fn in (("min", F.min), ("max", F.max), ("mean", F.avg),
                            ("sd", F.stddev_pop), ("var", F.var_pop)):
                cells.append(fn(number).alias(f"_{tag}{i}"))
            spread = [F.col(f"_{tag}{i}") for tag in ("min", "max", "mean", "sd", "var")]
            rows.append(F.struct(F.lit(name), F.lit(kind), filled, *spread,
                                 F.col(f"_d{i}"), missing))
        else:
            rows.append(F.struct(F.lit(name), F.lit(kind), F.col("_rows"), *[none] * 5,
                                 F.col(f"_d{i}"), missing))
    if not rows:
        return df.sparkSession.createDataFrame([], STATS_SCHEMA)
    typed = [r.cast(STATS_SCHEMA) for r in rows]
    # Spark sends rows once for each exact distinct count: the other cells need not go with them.
    if count_distinct is F.count_distinct:
        counted = inputs.agg(*sets).select(F.struct("*")).scalar()
        found = inputs.agg(*cells).withColumn("_sets", counted).select("*", "_sets.*")
    else:
        found = inputs.agg(*cells, *sets)
    return found.select(F.inline(F.array(*typed)))


def profile_histogram(df: DataFrame, columns, buckets: int = 10, exact: bool = False,
                      *, numbers: str, stats: DataFrame | None = None) -> DataFrame:
    """Bars per column: ``column``, ``position``, ``x`` (label) and ``y`` (count).

    ``ranges`` are that many buckets of even width, the last one closed; ``values``
    are the most frequent values. Text gets values. For ``numbers`` the caller
    chooses ranges, values, or ``by_count``: ranges if there are more distinct
    values than buckets, as counted (a sketch decides unless ``exact``). Ranges over infinite
    values are an error. One job reads
    the ranges, one counts all columns. Where the rows of ``profile_stats`` are at hand as ``stats``, the
    first job is saved; distinct values are counted only if the choice of chart needs them.
    """
    columns = names(columns)
    require(buckets > 0, "the number of buckets must be positive")
    if stats is None:
        stats = profile_stats(df, columns, exact) if numbers == "by_count" else _stats(df, columns)
    known = {row["column"]: row for row in stats.where(F.col("column").isin(columns)).collect()}
    return _bars(df, columns, known, buckets, numbers)


def _bars(df: DataFrame, columns, stats: dict, buckets: int, numbers: str) -> DataFrame:
    """``stats`` holds one row per column, so it is small on the driver."""
    require(numbers in ("by_count", "ranges", "values"), f"unknown kind of chart: {numbers}")
    spark = df.sparkSession
    entries, edges = [], []
    for i, name in enumerate(columns):
        row = stats.get(name)
        if row is None:
            continue
        value = present(df, name)
        wide = numbers == "ranges" or numbers == "by_count" and row["countdistinct"] > buckets
        if row["kind"] == "numeric" and wide and row["min"] is not None:
            low, high = row["min"], row["max"]
            require(math.isfinite(low) and math.isfinite(high),
                    f"column {name} has infinite values, which no range holds")
            marks = [low + (s * (high - low)) / buckets for s in range(buckets)] + [high]
            edges += [(i, p, a, b) for p, (a, b) in enumerate(zip(marks, marks[1:]))]
            share = (value.cast("double") - F.lit(low)) / F.lit((high - low) or 1.0)
            bucket = F.least(F.floor(share * F.lit(buckets)), F.lit(buckets - 1))
            place, key = F.when(value.isNotNull(), bucket).cast("int"), F.lit(None).cast("string")
        else:
            place, key = F.lit(None).cast("int"), value.cast("string")
        entries.append(F.struct(F.lit(i).alias("_c"), place.alias("_p"), key.alias("_k")))
    schema = "column string, position int, x string, y bigint"
    if not entries:
        return spark.createDataFrame([], schema)
    counts = (df.select(F.inline(F.array(*entries)))
              .where(F.col("_p").isNotNull() | F.col("_k").isNotNull())
              .groupBy("_c", "_p", "_k").agg(F.count(F.lit(1)).alias("_y")))
    # Only the largest counts of each column are shuffled; a column of ranges has no
    # more than that. What remains is columns x buckets rows.
    order = Window.partitionBy("_c").orderBy(F.desc("_y"), F.asc("_k"), F.asc("_p"))
    top = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= buckets)
    # Empty buckets must appear as well.
    ranges = spark.createDataFrame(edges, "_c int, _p int, _low double, _high double")
    labels = F.array(*[F.lit(c) for c in columns])
    span = F.concat_ws("-", F.col("_low").cast("string"), F.col("_high").cast("string"))
    return ranges.join(top, ["_c", "_p"], "full").select(
        F.element_at(labels, F.col("_c") + 1).alias("column"),
        F.coalesce(F.col("_p"), F.col("_r") - 1).alias("position"),
        F.coalesce(F.col("_k"), span).alias("x"),
        F.coalesce("_y", F.lit(0)).alias("y"))


def profile(df: DataFrame, columns, buckets: int = 10, exact: bool = False,
            *, numbers: str) -> DataFrame:
    """One row per column: ``column`` and its report ``vis`` as JSON.

    The report has ``name``, ``statistics`` and ``histogram`` (see
    ``profile_histogram``); it is empty for nested and binary columns.
    """
    columns = names(columns)
    stats = profile_stats(df, columns, exact).collect()
    by_column = {row["column"]: row for row in stats}
    spark = df.sparkSession
    reports = spark.createDataFrame(
        [(i, c, _report(by_column.get(c))) for i, c in enumerate(columns)],
        "_i int, column string, statistics array<struct<name:string,displayName:string,"
        "value:string,description:string>>")
    bars = (_bars(df, columns, by_column, buckets, numbers).groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("position", "x", "y"))).alias("_bars")))
    empty = F.array().cast("array<struct<position:int,x:string,y:bigint>>")
    joined = reports.join(bars, "column", "left").withColumn(
        "_bars", F.coalesce(F.col("_bars"), empty))
    vis = F.to_json(F.struct(
        F.col("column").alias("name"), "statistics",
        F.struct(F.col("_bars.x").alias("x"), F.col("_bars.y").alias("y")).alias("histogram")))
    return joined.orderBy("_i").select("column", vis.alias("vis"))


def _report(row) -> list[tuple]:
    if row is None:
        return []
    report = NUMERIC_REPORT if row["kind"] == "numeric" else TEXT_REPORT
    lines = [(name, title, str(row[name]), "") for name, title in report]
    return [*lines, ("columntype", "Feature Type", KIND_TITLES[row["kind"]], "")]


def as_text(field: T.StructField) -> Column:
    """A cell as text: structs and maps as JSON, arrays in brackets."""
    value, kind = col(field.name), field.dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType):
        inner = F.array_join(value.cast("array<string>"), ",", "null")
        text = F.concat(F.lit("["), inner, F.lit("]"))
    elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        text = F.to_json(value)
    elif isinstance(kind, T.BinaryType):
        text = F.base64(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null")).alias(field.name)


def preview(df: DataFrame, n: int = 100, order_by=None) -> DataFrame:
    """The first rows, every cell as text."""
    first = df.orderBy(*sort_columns(df, order_by)) if order_by else df
    return first.limit(n).select([as_text(f) for f in df.schema])


def page(df: DataFrame, order_by, number: int, rows: int, within: int | None = None) -> DataFrame:
    """Page ``number`` (from 1) of all rows, or of the first ``within``.

    Spark keeps all rows up to the page's last in one task: right for the first pages. For any
    depth, and for many pages, build a ``PageDirectory``.
    """
    require(number >= 1 and rows >= 1, "pages and rows are counted from 1")
    start = (number - 1) * rows
    keep = rows if within is None else max(0, min(rows, within - start))
    ordered = df.orderBy(*sort_columns(df, order_by))
    return ordered.offset(start).limit(keep).select([as_text(f) for f in df.schema])


def page_count(df: DataFrame, rows: int, within: int | None = None) -> int:
    """The number of pages of all rows, or of the first ``within``."""
    require(rows >= 1, "a page has at least one row")
    return math.ceil((df if within is None else df.limit(within)).count() / rows)


def schema_json(df: DataFrame) -> str:
    """The schema as JSON ``{"fields": [{"name", "type", "nullable"}]}``; no job runs."""
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable}
              for f in df.schema]
    return json.dumps({"fields": fields})


def observe_counts(df: DataFrame, name: str = "counts") -> tuple[DataFrame, Observation]:
    """The same frame, counting its rows and NULLs while a job runs over it.

    After the job ``observation.get`` has ``rows`` and ``{column}_nulls``. The
    plan stays open to pushdown and pruning of what follows.

    Spark 4.1 cannot score some classifiers in a session that has observed a
    frame, as their training summaries drag the session along. Where a job
    does both, read the observed frame through ``spark.newSession()``.
    """
    observation = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(col(c).isNull()).alias(f"{c}_nulls") for c in df.columns]
    return df.observe(observation, *metrics), observation
