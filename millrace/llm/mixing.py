"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source the rows are taken in the order of their keys
until the source's budget is used up exactly; a budget above the size of the source takes the whole
source again (an epoch) before the cut. Running totals over a source of any size come from two
levels: sums per range of keys, then running sums inside a range, so that no task holds a source.

Defined results: a null size counts as 0; a null source is a source of its own, the last; rows that
are equal in source, id and size are counted once and multiplied, so a row that repeats without end
stays one record until the last step; each of them has its own place in the order. Equal keys are
ordered by id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.util import col, written

_KEY_BITS = 60


def random_key(identifier: Column, seed: int) -> Column:
    """A whole number of 60 bits, the same on every run: the head of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source: its target, if all sources together give as much as they hold.

    ``sizes`` has one row per source (source, source_size). Weights repeat ``cycle`` over the
    sources by code point, null last. A target ends at ``most`` times the source's size; what is
    over goes to the others by weight, until none is above. That is one water level: with the
    sources in the order of size per weight, those that are full come first.
    The windows here run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w).cast("bigint") for w in cycle])
    weighed = sizes.withColumn("weight", F.get(weights, F.pmod(
        F.row_number().over(by_name) - 1, F.lit(len(cycle)))))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"),
                             F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ceiling = F.col("source_size") * most
    level = weighed.select(
        "*", ceiling.alias("ceiling"), F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(ceiling).over(before), F.lit(0)).alias("full_before"),
        F.sum("weight").over(rest).alias("weight_left"))
    full = (F.col("ceiling") * F.col("weight_left")
            <= F.col("weight") * (F.col("total") - F.col("full_before")))
    marked = level.withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    share = (F.col("weight") * (F.col("total") - taken)).cast("double") / open_weight.cast("double")
    return marked.select(
        "source", "source_size", "weight",
        F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(share).alias("target"))


def mix(df: DataFrame, identifier: str, source: str, size: str, seed: int = 0,
        cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, rows_per_range: int = 100_000
        ) -> DataFrame:
    """One row per input row: id, source, size, source_size, weight, target, taken.

    ``taken`` is the number of units (words, tokens) that the mix takes from the row, repeats
    counted. A source's takings add up to its target, rounded down.
    """
    rows = (df.select(col(identifier).alias("id"), col(source).alias("source"),
                      F.coalesce(col(size), F.lit(0)).cast("bigint").alias("size"))
            .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    rows = written(rows, "mix-rows")  # narrow; read several times below
    weight_of = F.sum(F.col("size") * F.col("copies"))
    sources = rows.groupBy("source").agg(
        weight_of.alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranges = F.ceil(F.col("n_rows") / rows_per_range).cast("bigint")
    plan = targets(sources.select("source", "source_size"), cycle, most)
    # One row per source; Spark broadcasts it only if its own size check allows it.
    plan = plan.join(sources.select(F.col("source").alias("s"), ranges.alias("n_ranges")),
                     F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = rows.withColumn("key", random_key(F.col("id"), seed))
    width = F.lit(float(1 << _KEY_BITS))
    placed = (keyed.join(plan.withColumnRenamed("source", "s"),
                         F.col("source").eqNullSafe(F.col("s"))).drop("s")
              .withColumn("range", F.least(F.floor(F.col("key") / width * F.col("n_ranges")),
                                           F.col("n_ranges") - 1)))
    earlier = (Window.partitionBy("source").orderBy("range")
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = (placed.groupBy("source", "range").agg(weight_of.alias("in_range"))
              .select(F.col("source").alias("s"), F.col("range").alias("r"),
                      F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("ranges_before")))
    inside = (Window.partitionBy("source", "range").orderBy("key", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    running = placed.withColumn("rows_before", F.coalesce(
        F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    joined = running.join(totals, F.col("source").eqNullSafe(F.col("s"))
                          & (F.col("range") == F.col("r"))).drop("s", "r")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.col("copies") - 1)))
    budget = F.floor("target")
    start = F.col("ranges_before") + F.col("rows_before") + F.col("copy") * F.col("size")
    whole = F.when(F.col("source_size") > 0, budget - budget % F.col("source_size")).otherwise(0)
    epochs = F.when(F.col("source_size") > 0,
                    (whole / F.greatest(F.col("source_size"), F.lit(1))).cast("bigint")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole - start))
    return each.select("id", "source", "size", "source_size", "weight", "target",
                       (epochs * F.col("size") + part).cast("bigint").alias("taken"))
