"""Run a registered query and its SQL, and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet("
                    f"'{os.path.join(folder, name + '.parquet')}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


# DuckDB type -> Spark type, for the types results may have.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "BOOLEAN": "boolean", "FLOAT": "float", '"NULL"': "void"}


def compare(spark, con, folder, function, sql) -> str | None:
    """None if both agree, else what differs."""
    df = function(spark, folder)
    columns, got = df.columns, [tuple(r) for r in df.collect()]
    answer = con.sql(sql)
    if sorted(columns) != sorted(answer.columns):
        return f"columns {sorted(columns)} != {sorted(answer.columns)}"
    theirs = {c: TYPES.get(str(t), str(t)) for c, t in zip(answer.columns, answer.types)}
    types = {c: (t, theirs[c]) for c, t in df.dtypes if t != theirs[c] and "array" not in t}
    want = answer.fetchall()
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _rows(columns, got), _rows(answer.columns, want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}"
    if types:
        return f"types differ: {types}"
    return None
