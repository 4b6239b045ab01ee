"""Sinks: files, tables and JDBC. A sink returns nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.sources.readers import jdbc_properties


# Text formats keep microseconds; Spark's own default cuts them to milliseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
          "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def write_parquet(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).parquet(path)


def write_orc(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).orc(path)


def write_json(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).options(**_TIMES).json(path)


def write_text(df: DataFrame, path: str, mode: str) -> None:
    """The frame must have exactly one text column."""
    df.write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str, sep: str = ",", header: bool = False) -> None:
    df.write.mode(mode).options(**_TIMES).option("sep", sep).option("header", header).csv(path)


def write_table(df: DataFrame, table: str, mode: str, partition_by=(),
                path: str | None = None) -> None:
    """Save as a catalog table, kept at ``path`` if one is given."""
    writer = df.write.mode(mode)
    if path is not None:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def write_jdbc(df: DataFrame, url: str, table: str, properties=None, mode: str = "error") -> None:
    df.write.mode(mode).jdbc(url, table, properties=jdbc_properties(properties))
