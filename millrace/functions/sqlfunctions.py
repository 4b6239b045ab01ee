"""The functions that SQL statements may call once they are registered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import _hash_batch
from millrace.functions.vectors import SIMILARITY_CUTS

# SQL functions that are plain expressions over others.
EXPRESSIONS = {
    "encode3(p int, a bigint, b bigint) returns bigint":
        "encode2(p, try_cast(concat(cast(a as string), cast(b as string)) as bigint))",
    "encode5(p int, a bigint, b bigint, q int, c bigint) returns bigint":
        "encode4(p, try_cast(concat(cast(a as string), cast(b as string)) as bigint), q, c)",
    "csv_dot(a string, b string) returns double": """
        get(transform(array(struct(split(a, ',') as u, split(b, ',') as v)), s ->
          case when s.u is null or s.v is null then null
               when size(s.u) <> size(s.v) then -1.0D
               else aggregate(zip_with(s.u, s.v, (x, y) ->
                 cast(trim(x) as double) * cast(trim(y) as double)), 0D, (t, x) -> t + x) end), 0)""",
    "similarity_bucket(a string, b string) returns bigint": f"""
        get(transform(array(csv_dot(a, b)), s -> if(s is null, null,
          1 + size(filter(array({", ".join(f"{c!r}D" for c in SIMILARITY_CUTS)}), c -> c <= s)))), 0)""",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``dot``, ``encode2`` … ``encode5``, ``csv_dot`` and ``similarity_bucket`` callable.

    ``dot`` takes ML vectors or arrays of double. The encoders take int prefixes
    and bigint values.
    """
    @F.arrow_udf("bigint")
    def encode2(prefix: pa.Array, value: pa.Array) -> pa.Array:
        return _hash_rows([prefix], [value])

    @F.arrow_udf("bigint")
    def encode4(prefix1: pa.Array, value1: pa.Array, prefix2: pa.Array,
                value2: pa.Array) -> pa.Array:
        return _hash_rows([prefix1, prefix2], [value1, value2])

    @F.arrow_udf("double")
    def dot(a: pa.Array, b: pa.Array) -> pa.Array:
        return dot_batch(a, b)

    for name, function in (("encode2", encode2), ("encode4", encode4), ("dot", dot)):
        spark.udf.register(name, function)
    for signature, expression in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {expression}")


def _hash_rows(prefixes: list[pa.Array], values: list[pa.Array]) -> pa.Array:
    """The rows of each combination of prefixes are hashed together."""
    missing = np.zeros(len(values[0]), dtype=bool)
    for column in (*prefixes, *values):
        missing |= column.is_null().to_numpy(zero_copy_only=False)
    keys = np.stack([p.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                     for p in prefixes])
    out = np.zeros(len(missing), dtype=np.int64)
    for combination in np.unique(keys, axis=1).T:
        rows = np.flatnonzero((keys == combination[:, None]).all(axis=0))
        part = _hash_batch([int(p) for p in combination],
                           [v.take(pa.array(rows)) for v in values])
        out[rows] = part.fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(out, type=pa.int64(), mask=missing)


def _entries(column: pa.Array):
    """(row, slot, value) of all stored elements, the rows' sizes, and which rows are NULL."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    sparse = None
    values = column
    if pa.types.is_struct(column.type):
        kind, size, indices, values = (column.field(n) for n in ("type", "size", "indices",
                                                                 "values"))
        sparse = ~missing & (kind.fill_null(1).to_numpy(zero_copy_only=False) == 0)
        values = pc.if_else(pa.array(~missing), values, pa.scalar(None, values.type))
    counts = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = counts.astype(np.int64)
    if sparse is not None and sparse.any():
        rows = pa.array(np.flatnonzero(sparse))
        slot[sparse[row]] = indices.take(rows).flatten().to_numpy(zero_copy_only=False)
        sizes[sparse] = size.take(rows).to_numpy(zero_copy_only=False)
    return row, slot, flat, sizes, missing


def dot_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Dot products of two columns of vectors, dense or sparse, or of arrays."""
    row_a, slot_a, value_a, size_a, missing_a = _entries(a)
    row_b, slot_b, value_b, size_b, missing_b = _entries(b)
    missing = missing_a | missing_b
    if ((size_a != size_b) & ~missing).any():
        raise ValueError("vectors differ in length")
    width = int(max(size_a.max(initial=0), size_b.max(initial=0))) + 1
    key_a, key_b = row_a * width + slot_a, row_b * width + slot_b
    at = np.searchsorted(key_b, key_a)
    at[at == len(key_b)] = 0
    same = key_b[at] == key_a if len(key_b) else np.zeros(len(key_a), dtype=bool)
    products = value_a[same] * value_b[at[same]]
    total = np.bincount(row_a[same], weights=products, minlength=len(missing))
    return pa.array(total.astype(np.float64), mask=missing)
