"""Models over tables whose columns are independent, as in larger ones: chance helps no fit."""

import pytest
from pyspark.sql import functions as F

from millrace.ml import models
from millrace.plans import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("drawn")
    i = F.col("id")
    # Every quantity, discount and tax has the same twenty prices.
    lines = spark.range(20 * 50 * 11 * 9, numPartitions=8).select(
        i.alias("l_orderkey"), F.lit(0).cast("bigint").alias("l_partkey"),
        F.lit(0).cast("bigint").alias("l_suppkey"),
        (F.floor(i / 20) % 50 + 1).cast("double").alias("l_quantity"),
        (i % 20 * 5000 + 900).cast("double").alias("l_extendedprice"),
        (F.floor(i / 1000) % 11 / 100).alias("l_discount"),
        (F.floor(i / 11000) / 100).alias("l_tax"))
    vectors = spark.range(40_000, numPartitions=8).select(
        i.alias("vec_id"), F.floor(F.rand(9) * 10).cast("int").alias("label"),
        F.array(*[(F.randn(100 + k) / 8).cast("float") for k in range(64)]).alias("embedding"))
    for name, table in {"lineitem": lines, "embeddings": vectors}.items():
        table.write.parquet(str(base / f"{name}.parquet"))
    return str(base)


@pytest.mark.parametrize("name", ["dtree_reg", "rforest_reg", "gbt_reg"])
def test_beats_mean(spark, folder, name):
    assert QUERIES[name](spark, folder).first()["beats_mean"]


def test_beats_majority(spark, folder):
    assert QUERIES["naive_bayes_score"](spark, folder).first()["beats_majority"]


def test_als_is_near_its_optimum(spark, tmp_path):
    """Factors begin with random signs: without a mean, more customers need more steps."""
    def drawn(name, below, seed):
        return F.floor(F.rand(seed) * below).cast("bigint").alias(name)
    spark.range(600_000, numPartitions=8).select(
        drawn("l_orderkey", 150_000, 1), drawn("l_partkey", 20_000, 2),
        (drawn("q", 50, 3) + 1).cast("double").alias("l_quantity")).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.range(150_000, numPartitions=4).select(
        F.col("id").alias("o_orderkey"), drawn("o_custkey", 15_000, 7)).write.parquet(
        str(tmp_path / "orders.parquet"))
    row = QUERIES["als"](spark, str(tmp_path)).first()
    assert row["beats_mean"] and row["n_unsolved"] == 0


def test_als_blocks_hold_a_bounded_number_of_ratings(spark, monkeypatch):
    monkeypatch.setattr(models, "_BLOCK", 100)
    ratings = spark.range(1250).select(
        (F.col("id") % 90).cast("int").alias("user"), (F.col("id") % 70).cast("int").alias("item"),
        (F.col("id") % 5).cast("double").alias("rating"))

    def blocks(**params):
        model = models.train(models.make_estimator("als", rank=2, maxIter=1, seed=1, **params), ratings)
        return [f.rdd.getNumPartitions() for f in (model.userFactors, model.itemFactors)]
    assert blocks() == [13, 13]
    assert blocks(numUserBlocks=3) == [3, 13]
    monkeypatch.setattr(models, "_BLOCK", 1000)
    assert blocks() == [10, 10]
