"""Files that tasks write: deterministic shards, temporary names, manifests.

Tasks write under names of their own and report what they wrote. Only the report of a successful
attempt becomes part of the manifest, so an attempt that is lost or repeated leaves nothing but a
temporary file. A second job gives the files their names, in parallel, and the manifest is written
last: what it lists is there.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.text import partitions, rank_among
from millrace.util import col

MANIFEST = "shard int, part int, temporary string, name string, records long, units long, bytes long"
_FIELDS = [c.split() for c in MANIFEST.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
MANIFEST_ARROW = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as the session resolves it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return full.replace("file:/", "file:///", 1) if not full.startswith("file://") else full


def file_system(uri: str):
    """(file system, path) of a qualified path; any scheme that Arrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def range_shards(df: DataFrame, order: str, shards: int | None = None, per_shard: int = 100
                 ) -> tuple[DataFrame, list]:
    """Add ``_shard``, the number of the row's range of ``order``; return the limits too.

    The limits come from the values with small hashes: about ``per_shard`` for each shard, whatever
    the size of the table, and the same ones on every run. They only balance the shards. Rows without
    a value are in the first shard.
    """
    shards = shards or partitions(df.sparkSession)
    value = col(order)
    share = min(1.0, shards * per_shard / max(1, df.count()))
    small = F.pmod(F.xxhash64(value), F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))
    chosen = df.where(value.isNotNull() & small).select(value.alias("v")).distinct()
    values = sorted(r["v"] for r in chosen.collect())
    limits = sorted({values[len(values) * i // shards] for i in range(1, shards)}) if values else []
    points = F.lit(limits).cast("array<bigint>") if limits else F.array().cast("array<bigint>")
    return df.withColumn("_shard", F.coalesce(rank_among(points, value, len(limits)), F.lit(0))
                         .cast("int")), limits


def in_shards(df: DataFrame, n: int, *order) -> DataFrame:
    """One partition per shard, each sorted by ``order``."""
    return df.repartitionById(n, F.col("_shard")).sortWithinPartitions("_shard", *order)


class ShardFiles:
    """Inside a task: open the files of the shards that come by, and report them."""

    def __init__(self, root: str, suffix: str):
        from pyspark import TaskContext
        self.system, self.root = file_system(root)
        self.attempt = f"{TaskContext.get().taskAttemptId()}"
        self.suffix, self.stream = suffix, None
        self.system.create_dir(posixpath.join(self.root, "_temporary"), recursive=True)
        self.done: list[dict] = []

    def open(self, shard: int, part: int):
        self.row = {"shard": shard, "part": part,
                    "temporary": f"_temporary/{shard:06d}-{part:05d}-{self.attempt}{self.suffix}",
                    "name": f"shard-{shard:06d}-{part:05d}{self.suffix}", "records": 0, "units": 0, "bytes": 0}
        self.stream = self.system.open_output_stream(
            posixpath.join(self.root, self.row["temporary"]))

    def write(self, data: bytes, records: int = 1, units: int = 0) -> int:
        """Append, and return the size of the file so far. Units are what the format counts."""
        self.stream.write(data)
        self.row["records"] += records
        self.row["units"] += units
        self.row["bytes"] += len(data)
        return self.row["bytes"]

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append(self.row)
            self.stream = None

    def report(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist(self.done, schema=MANIFEST_ARROW)
        self.done = []


def _publish(root: str) -> Callable:
    def move(batches):
        from pyarrow import fs
        system, base = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                old = posixpath.join(base, row["temporary"])
                new = posixpath.join(base, row["name"])
                if system.get_file_info(old).type != fs.FileType.NotFound:
                    system.move(old, new)  # a second attempt finds it moved
                elif system.get_file_info(new).type == fs.FileType.NotFound:
                    raise FileNotFoundError(new)
            yield batch
    return move


def write_files(spark: SparkSession, root: str, placed: DataFrame, writer: Callable) -> DataFrame:
    """Run ``writer(root)`` over the partitions, publish what it reports; return the manifest."""
    root = qualified(spark, root)
    staged = f"{root}/_staged"
    placed.mapInArrow(writer(root), MANIFEST).write.mode("errorifexists").parquet(staged)
    listed = spark.read.schema(MANIFEST).parquet(staged)
    moved = listed.repartition(partitions(spark)).mapInArrow(_publish(root), MANIFEST)
    moved.write.mode("errorifexists").parquet(f"{root}/_manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{qualified(spark, root)}/_manifest")


def read_files(spark: SparkSession, root: str, reader: Callable, schema: str) -> DataFrame:
    """Read the files that the manifest lists, each by one task.

    The reader gets shard, part, name and the number of units in earlier files. The sums run over
    files: first within a shard, then over one row per shard, of which there are as many as
    partitions.
    """
    root = qualified(spark, root)
    listed = manifest(spark, root)
    before = (Window.unboundedPreceding, -1)
    shards = listed.groupBy("shard").agg(F.sum("units").alias("of_shard")).select(
        "shard", F.coalesce(F.sum("of_shard").over(Window.orderBy("shard").rowsBetween(*before)),
                            F.lit(0)).alias("shards_before"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(*before)
    placed = (listed.withColumn("parts_before", F.coalesce(F.sum("units").over(inside), F.lit(0)))
              .join(shards, "shard")
              .select("shard", "part", "name",
                      (F.col("shards_before") + F.col("parts_before")).alias("before")))
    return (placed.repartition(partitions(spark), "shard", "part")
            .mapInArrow(reader(root), schema))
