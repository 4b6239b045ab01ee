"""Sources: files, tables, SQL, JDBC and keyed binary files."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.util import pairs, require


def _paths(paths) -> list[str]:
    """Paths given one by one or as comma-separated lists."""
    out = [p.strip() for item in paths for p in item.split(",") if p.strip()]
    require(bool(out), "at least one path is needed")
    return out


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*_paths(paths))


def read_orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(_paths(paths))


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per line, in the column ``value``."""
    return spark.read.text(_paths(paths))


def read_csv(spark: SparkSession, *paths: str, sep: str = ",", header: bool = True,
             schema=None) -> DataFrame:
    """Delimited text, trimmed; without a schema an extra pass infers the types."""
    reader = (spark.read.option("sep", sep).option("header", header)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(_paths(paths))


def read_json(spark: SparkSession, *paths: str, multiline: bool = False, schema=None) -> DataFrame:
    """JSON lines, or whole JSON files with ``multiline``."""
    reader = spark.read.option("multiLine", multiline)
    return (reader if schema is None else reader.schema(schema)).json(_paths(paths))


def read_table(spark: SparkSession, table: str, condition: str | None = None) -> DataFrame:
    """A catalog table, filtered if a condition is given."""
    df = spark.table(table)
    return df.where(condition) if condition else df


def read_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Any Spark SQL over the catalog's tables and views."""
    return spark.sql(sql)


def jdbc_properties(text) -> dict[str, str]:
    """Connection properties from a mapping or from ``key=value;key=value``."""
    if not isinstance(text, str):
        return dict(text or {})
    items = [item.split("=", 1) for item in text.split(";") if item]
    require(all(len(item) == 2 for item in items), "properties are written key=value;key=value")
    return dict(items)


def read_jdbc(spark: SparkSession, url: str, table: str, properties=None,
              partition=None) -> DataFrame:
    """A database table; ``partition`` is (column, lower, upper, number of parts).

    Without ``partition`` one task reads everything, so give it for large tables.
    """
    split = {}
    if partition is not None:
        require(len(partition) == 4, "partition is (column, lower, upper, parts)")
        split = dict(zip(("column", "lowerBound", "upperBound", "numPartitions"), partition))
    return spark.read.jdbc(url, table, properties=jdbc_properties(properties), **split)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``label`` and the sparse vector ``features``.

    Give the number of features to save the pass that looks for it.
    """
    reader = spark.read.format("libsvm")
    return (reader if num_features is None else
            reader.option("numFeatures", num_features)).load(path)


def day_segment(choice: str, today: datetime.date | None = None) -> str:
    """The day part of a path: yesterday for ``current``, ``history``, or ``*`` for ``all``."""
    require(choice in ("current", "history", "all"), f"unknown choice of days: {choice}")
    if choice == "current":
        return f"{(today or datetime.date.today()) - datetime.timedelta(days=1):%Y%m%d}"
    return "*" if choice == "all" else choice


def read_keyed_binary(spark: SparkSession, path: str, key_pattern: str, key_names,
                      path_pattern: str | None = None, path_names=(), values=None,
                      layout: str = "sequence") -> DataFrame:
    """Binary values with a text key: ``key``, ``value``, ``path`` and derived columns.

    ``layout`` is ``sequence`` for sequence files of (text, bytes), or ``files``
    for one value per file, whose name is the key. ``values`` fills the
    ``{name}`` places of the path; a place may hold ``*`` or a ``day_segment``. The groups of
    ``key_pattern`` and ``path_pattern`` become the columns ``key_names`` and
    ``path_names``.
    """
    require(layout in ("sequence", "files"), f"unknown layout: {layout}")
    for name, value in pairs(values or {}):
        path = path.replace("{" + name + "}", value)
    if layout == "files":
        read = spark.read.format("binaryFile").load(path)
        df = read.select(F.element_at(F.split("path", "/"), -1).alias("key"),
                         F.col("content").alias("value"), "path")
    else:
        schema = T.StructType([T.StructField("key", T.StringType()),
                               T.StructField("value", T.BinaryType())])
        records = spark.sparkContext.sequenceFile(path)
        df = spark.createDataFrame(records, schema).withColumn("path", F.input_file_name())
    groups = {name: F.regexp_extract("key", key_pattern, i + 1)
              for i, name in enumerate(key_names)}
    if path_pattern is not None:
        groups |= {name: F.regexp_extract("path", path_pattern, i + 1)
                   for i, name in enumerate(path_names)}
    return df.withColumns(groups) if groups else df
