"""Line deduplication against levelled sorted runs of line hashes.

A ``LineRuns`` store holds, per line key, a 96-bit hash and the number of documents that have the
line. Every batch becomes a run: a table bucketed and sorted by the hash, so that a later batch
merges with it without moving the run. Runs live on levels; when a level has ``fanout`` runs they
are merged into one run of the next level, so a store of n batches has about log(n) runs to look
through, and each key is rewritten about log(n) times.

Compaction also finds the frequent keys. ``add`` merge-anti-joins a batch with the runs of frequent
keys and adds what is left as the batch's own run; ``frequent`` sums the runs. ``drop_lines`` then
takes the lines with given keys out of documents.

Defined results: a null or empty text is one empty line; keys are lines without white space at both
ends and with A-Z in lower case; a key shorter than ``least`` code points is never dropped. A text
that loses every line becomes an empty text. Rows that repeat are documents of their own when
documents are counted, and all lose the same lines. Empty tables give empty stores and results.
Other columns of the documents are kept as they are; n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import ALL_SPACES, lower_ascii, partitions
from millrace.util import col, require, scratch, written

HASH = ("line_hash", "line_check")


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(ALL_SPACES)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(key: Column) -> list[Column]:
    """96 bits: at a trillion lines a shared hash is still unlikely."""
    return [F.xxhash64(key).alias(HASH[0]),
            F.hash(key).alias(HASH[1])]


def document_lines(df: DataFrame, text: str = "text", least: int = 1, *keep: str) -> DataFrame:
    """One row per document and distinct line key of at least ``least`` code points."""
    keys = F.array_distinct(F.transform(split_lines(col(text)), line_key))
    long_enough = F.filter(keys, lambda k: F.length(k) >= least)
    return (df.select(*[col(c) for c in keep], F.explode(long_enough).alias("_key"))
            .select(*[col(c) for c in keep], *_hashes(F.col("_key"))))


class LineRuns:
    """Levelled runs of (hash, number of documents), kept as bucketed tables.

    Keys that a compaction finds in ``least_docs`` documents or more also go to a run of frequent
    keys. A later batch is anti-joined with those runs first: what is known to be frequent need
    not be counted any more.
    """

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int = 4,
                 buckets: int | None = None):
        require(fanout > 1, "a level needs room for two runs at least")
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.known: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, counted: DataFrame) -> str:
        """A run: bucketed and sorted by hash. The path is shared and survives a lost executor."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "line-run")
        (counted.select(*HASH, "n_docs").repartition(self.buckets, *HASH)
         .write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", self.paths[name]).saveAsTable(name))
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")

    def _sum(self, names: list[str]) -> DataFrame:
        # Read by path, not as tables: Spark 4.1 takes a union of bucketed scans for partitioned
        # and then reads them without their buckets, so equal keys of two runs would not be summed.
        together = self.spark.read.schema(f"{HASH[0]} long, {HASH[1]} int, n_docs long").parquet(
            *[self.paths[n] for n in names])
        return together.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def unknown(self, counted: DataFrame) -> DataFrame:
        """The merge anti-join of a batch with the runs of frequent keys, one after the other."""
        for name in self.known:
            counted = counted.join(self.spark.table(name).hint("merge"), list(HASH), "left_anti")
        return counted

    def add(self, counted: DataFrame) -> None:
        """Add a batch (hash, n_docs; one row per key) as a run and compact the full levels."""
        self.levels[0].append(self._write(self.unknown(counted)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._sum(self.levels[level]))
            self._drop(self.levels[level])
            self.levels[level] = []
            self.known.append(self._write(
                self.unknown(self.spark.table(merged).where(F.col("n_docs") >= self.least_docs))))
            if len(self.levels) == level + 1:
                self.levels.append([])
            level += 1
            self.levels[level].append(merged)

    def frequent(self) -> DataFrame:
        """The keys with ``least_docs`` documents or more; a merged run still holds the known."""
        names = [name for level in self.levels for name in level]
        require(names, "no batch was added")
        return self._sum(names).where(F.col("n_docs") >= self.least_docs).select(*HASH)

    def forget(self) -> None:
        """Take the runs out of the catalog; write what was read from them before."""
        self._drop([name for level in self.levels for name in level] + self.known)
        self.levels, self.known = [[]], []


def drop_lines(df: DataFrame, keys: DataFrame, text: str = "text", least: int = 1,
               identifier: str = "doc_id") -> DataFrame:
    """The documents without the lines whose keys are in ``keys``; adds n_lines and n_dropped.

    A row is known by its id and a 128-bit hash of its text, so rows with a missing or repeated id
    cannot take lines from each other. Only positions of lost lines go back to the documents: a
    list that is never longer than the document's own lines.
    """
    row = [F.xxhash64(col(identifier), col(text)).alias("_row"),
           F.xxhash64(F.lit("row"), col(text), col(identifier)).alias("_row_check")]
    kept = [c for c in df.columns if c not in (text, "n_lines", "n_dropped")]
    # The other columns travel in a struct, so their names cannot meet those used here.
    marked = df.select(F.struct(*[col(c) for c in kept], F.lit(0).alias("_")).alias("_input"),
                       col(text).alias("_text"), *row)
    lines = (marked.select("_row", "_row_check", F.posexplode(split_lines(F.col("_text"))))
             .select("_row", "_row_check", F.col("pos"), line_key(F.col("col")).alias("_key"))
             .where(F.length("_key") >= least)
             .select("_row", "_row_check", "pos", *_hashes(F.col("_key"))))
    lost = (lines.join(keys, list(HASH), "left_semi").groupBy("_row", "_row_check")
            .agg(F.collect_set("pos").alias("_lost")))
    joined = (marked.join(lost, ["_row", "_row_check"], "left")
              .withColumn("_all_lines", split_lines(F.col("_text"))))
    all_lines = F.col("_all_lines")
    remaining = F.when(F.col("_lost").isNull(), F.coalesce("_text", F.lit(""))).otherwise(
        F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_lost")),
            lambda i: F.get(F.col("_all_lines"), i)), "\n"))
    others = [F.col("_input").getField(c).alias(c) for c in kept]
    return joined.select(
        *others, remaining.alias(text), F.size(all_lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"))


def dedup_lines(df: DataFrame, text: str = "text", least_docs: int = 10, least: int = 1,
                identifier: str = "doc_id", batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop the lines whose key is in at least ``least_docs`` documents, in every document.

    The table arrives in ``batches`` (by a hash of the id); each adds its run to the store.
    """
    spark = df.sparkSession
    batch = F.pmod(F.xxhash64(col(identifier), F.lit("batch")), F.lit(batches)).alias("_batch")
    slim = df.select(col(text).alias("text"), batch)
    arriving = (document_lines(slim, "text", least, "_batch")
                .groupBy("_batch", *HASH).agg(F.count(F.lit(1)).alias("n_docs")))
    path = scratch(spark, "line-batches")
    arriving.write.partitionBy("_batch").parquet(path)
    arrived = spark.read.schema(arriving.schema).parquet(path)
    store = LineRuns(spark, least_docs, fanout)
    try:
        for number in range(batches):
            store.add(arrived.where(F.col("_batch") == number).drop("_batch"))
        keys = written(store.frequent(), "frequent-lines")
    finally:
        store.forget()
    return drop_lines(df, keys, text, least, identifier)
