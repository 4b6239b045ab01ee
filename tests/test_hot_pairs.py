"""A key that is hot on both sides: 40 billion pairs, which must not be made one by one."""

from pyspark.sql import functions as F

from millrace.plans import QUERIES


def test_pairs_of_a_hot_key_are_counted_by_groups(spark, tmp_path):
    n = 200_000
    spark.range(n + 3).select(
        F.when(F.col("id") < n, 0).when(F.col("id") == n, None).otherwise(F.col("id"))
        .cast("bigint").alias("l_orderkey"), F.lit(1.0).alias("l_quantity"),
        (F.col("id") % 2).cast("int").alias("l_linenumber")).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.range(n + 2).select(
        F.when(F.col("id") < n, 0).otherwise(F.col("id") + 2).alias("o_orderkey"),
        F.lit(3).cast("bigint").alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    rows = QUERIES["join_hot_both_sides"](spark, str(tmp_path)).collect()
    # Of the ids above n: null and n + 1 have no order, n + 2 has one; n + 3 has no line.
    assert sorted(map(tuple, rows), key=str) == sorted([
        (False, False, 0, n * n // 2 + 1, 3 * n * n // 2 + 3),
        (False, False, 1, n * n // 2, 3 * n * n // 2), (False, True, 1, 1, None),
        (True, True, 0, 1, None), (True, False, None, 1, 3)], key=str)
