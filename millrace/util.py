"""Names, parameter checks, salts and scratch space shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types that cannot be hashed or compared by Spark.
_UNHASHABLE = (T.MapType, T.VariantType)


def quoted(name: str) -> str:
    """Back-tick a column name, so that dots, colons and back-ticks are safe."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def names(columns: str | Iterable[str]) -> list[str]:
    out = [columns] if isinstance(columns, str) else list(columns)
    require(len(out) > 0, "at least one column is needed")
    return out


def pairs(mapping) -> list[tuple]:
    """Ordered pairs from a list of pairs or a dict."""
    items = mapping.items() if isinstance(mapping, Mapping) else mapping
    return [tuple(item) for item in items]


def check_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    missing = [c for c in wanted if c not in df.columns]
    require(not missing, f"no such column: {', '.join(missing)}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    check_columns(df, [name])
    return df.schema[name].dataType


def is_vector(df: DataFrame, name: str) -> bool:
    return type_of(df, name).typeName() == "vectorudt"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not use yet."""
    name = stem
    while name in df.columns:
        name += "_"
    return name


def same_type(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns, cast to text where their types have no common numeric type."""
    kinds = [type_of(df, c) for c in columns]
    alike = all(k == kinds[0] for k in kinds)
    if alike or all(isinstance(k, T.NumericType) for k in kinds):
        return [col(c) for c in columns]
    return [col(c).cast("string") for c in columns]


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash over all hashable columns of a row."""
    usable = [f.name for f in df.schema if not _contains_unhashable(f.dataType)]
    return F.xxhash64(*[col(c) for c in usable]) if usable else F.lit(0).cast("bigint")


def _contains_unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, _UNHASHABLE):
        return True
    if isinstance(kind, T.ArrayType):
        return _contains_unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_contains_unhashable(f.dataType) for f in kind)
    return kind.typeName() == "vectorudt"


def salt(df: DataFrame, buckets: int) -> Column:
    """Spread rows over ``buckets``, also when a key or a whole row repeats.

    The row hash separates rows that share a key, the input partition
    separates exact copies. Both are the same on every attempt of a task, so a
    lost executor cannot move a row to another bucket.
    """
    return F.pmod(F.xxhash64(row_hash(df), F.spark_partition_id()), F.lit(buckets)).cast("int")


_TEMPORARY: dict[str, str] = {}
_OWNED: ContextVar[list | None] = ContextVar("owned", default=None)


@contextmanager
def scratch_freed(spark: SparkSession):
    """Delete the scratch space of the operators used inside, at the end of the block.

    Write the result inside: what was not written can no longer be read afterwards.
    Blocks may be nested; each frees its own.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, one for each application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        require(master == "local" or master.startswith("local["),
                "set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _TEMPORARY:
            _TEMPORARY[application] = tempfile.mkdtemp(prefix="millrace-")
        base = _TEMPORARY[application]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _OWNED.get() is not None:
        _OWNED.get().append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the frame to shared scratch space and read it back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
