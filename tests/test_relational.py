import random
from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import relational as rel
from millrace.operators import reshape, sampling
from millrace.operators.ordering import prefix_sums, row_index, zip_columns


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def left3(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (None, "d", 4.0), (5, "e", 5.0)],
        "k int, s string, x double")


@pytest.fixture(scope="module")
def right5(spark):
    return spark.createDataFrame(
        [(1, "p", 10, True, 0.1), (1, "q", 20, False, 0.2), (3, "r", 30, True, 0.3),
         (None, "n", 40, True, 0.4)],
        "k int, t string, n int, f boolean, y double")


KINDS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


@pytest.mark.parametrize("how,options", list(product(KINDS, [{}, {"salts": 4},
                                                             {"spread_hot": True}])))
def test_join_against_brute_force(left3, right5, how, options):
    a = [tuple(r)[:2] for r in left3.collect()]
    b = [(r["k"], r["n"]) for r in right5.collect()]
    matched = [(x, y) for x in a for y in b if x[0] is not None and x[0] == y[0]]
    seen_a, seen_b = [x for x, _ in matched], [y for _, y in matched]
    lonely_a = [(*x, None, None) for x in a if x not in seen_a]
    lonely_b = [(None, None, *y) for y in b if y not in seen_b]
    both = [(*x, *y) for x, y in matched]
    want = {"inner": both, "left": both + lonely_a, "right": both + lonely_b,
            "full": both + lonely_a + lonely_b,
            "left_semi": [x for x in a if x in seen_a],
            "left_anti": [x for x in a if x not in seen_a]}[how]
    got = rel.join(left3, right5, [("lk", "rk")], how, [("k", "lk"), ("s", "s")],
                   [("k", "rk"), ("n", "n")], **options)
    assert rows(got) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def hot_sides(spark):
    """Keys that are hot on the left, on the right, on both, on one side only, and NULL."""
    nan, r = float("nan"), random.Random(3)
    a = [1.0] * 200 + [2.0] * 150 + [3.0] + [4.0] * 90 + [None] * 100 + [nan] * 40 + [-0.0] * 40
    b = [1.0] * 60 + [2.0] + [3.0] * 150 + [5.0] * 90 + [None] * 100 + [nan] * 3 + [0.0] * 3
    a += [float(r.randrange(10, 300)) for _ in range(200)]
    b += [float(r.randrange(10, 300)) for _ in range(200)]
    left = spark.createDataFrame([(k, n // 5) for n, k in enumerate(a)], "k double, s int")
    right = spark.createDataFrame([(k, n // 5) for n, k in enumerate(b)], "k double, t int")
    return left.repartition(4), right.repartition(4)


@pytest.mark.parametrize("how", KINDS)
def test_hot_keys_on_any_side(hot_sides, how):
    left, right = hot_sides
    names = {"left_cols": [("k", "a"), ("s", "s")], "right_cols": [("k", "b"), ("t", "t")]}
    got = rel.join(left, right, [("a", "b")], how, **names, spread_hot=True)
    want = rel.join(left, right, [("a", "b")], how, **names)
    assert list(map(repr, rows(got))) == list(map(repr, rows(want)))  # NaN is no NaN's equal


def test_hot_join_of_two_keys_and_types(spark):
    left = spark.createDataFrame([(1, bytearray(b"x"), n) for n in range(300)], "i int, k binary, v int")
    right = spark.createDataFrame([(1, bytearray(b"x"), n) for n in range(7)], "j long, m binary, w int")
    got = rel.join(left, right, [("i", "j"), ("k", "m")], spread_hot=True)
    assert got.count() == 2100 and got.select("v", "w").distinct().count() == 2100
    with pytest.raises(ValueError, match="cannot be spread"):
        rel.join(left, right, [("k", "j")], spread_hot=True)
    assert rel.join(left.limit(0), right, [("i", "j")], "right", spread_hot=True).count() == 7


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_a_third_of_the_right_side_in_one_key(spark, how):
    right = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("b"), F.col("id").alias("v"))
    left = spark.range(60_000).select(F.col("id").alias("a"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = rel.join(left, right, [("a", "b")], how, spread_hot=True)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_grid_is_bounded():
    from millrace.operators.hotjoin import grid
    assert grid(10**9, 1, 3 * 10**9, 10**9, 200) == (534, 1)
    assert grid(1, 10**9, 10**9, 3 * 10**9, 200) == (1, 534)
    a, b = grid(10**9, 10**9, 2 * 10**9, 2 * 10**9, 2000)
    assert 1 < a * b <= 64 * 2000
    assert grid(0, 5, 0, 5, 4) == (1, 5)


def test_join_names_order_and_self_join(left3, right5):
    wide = rel.join(left3, right5, [("key", "other")],
                    left_cols=[("x", "x"), ("k", "key"), ("s", "s")],
                    right_cols=[("y", "y"), ("f", "f"), ("n", "n"), ("t", "t"), ("k", "other")])
    assert wide.columns == ["x", "key", "s", "y", "f", "n", "t", "other"]
    # A key need not be in the output, and both sides may be the same frame.
    twice = rel.join(left3, left3, [("k", "k")], left_cols=[("s", "a")], right_cols=[("s", "b")])
    assert rows(twice) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c"), ("e", "e")]


def test_join_errors(left3, right5):
    with pytest.raises(ValueError, match="join type"):
        rel.join(left3, right5, [("k", "k")], "sideways")
    with pytest.raises(ValueError, match="pair of keys"):
        rel.join(left3, right5)
    with pytest.raises(ValueError, match="pair of join columns"):
        rel.join(left3, right5, ["k < k"])
    assert rel.join(left3, right5, ["k == k"], left_cols={"k": "k"}, right_cols={"n": "n"}).count() == 4
    with pytest.raises(ValueError, match="no such join column"):
        rel.join(left3, right5, [("k", "k")], left_cols=[("k", "key")])


def test_join_cross_and_hint(left3, right5):
    assert rel.join(left3, right5, how="cross").count() == 20
    plan = rel.join(left3, right5, [("k", "k")], hint="shuffle_hash")
    assert "ShuffledHashJoin" in plan._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        rel.join(left3, right5, [("k", "k")], hint="broadcast")


def test_salted_join_spreads_a_hot_key_and_copies(spark):
    hot = spark.range(4000, numPartitions=8).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    from millrace.util import salt
    used = hot.select(salt(hot, 16).alias("s")).distinct().count()
    assert used >= 4
    right = spark.createDataFrame([(1, "r")], "k int, w string")
    assert rel.join(hot, right, [("k", "k")], salts=16).count() == 4000


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_salted_copies_are_not_broadcast(spark, how):
    """Spark does not know that the copied side is larger than what it reads."""
    left, right = spark.range(1000).withColumnRenamed("id", "a"), spark.range(1000)
    joined = rel.join(left, right, [("a", "id")], how, salts=64)
    joined.collect()
    plan = joined._jdf.queryExecution().toString().splitlines()
    assert any("SortMergeJoin" in line and "_rs" in line for line in plan)
    assert not any("BroadcastHashJoin" in line and "_rs" in line for line in plan)
    assert joined.count() == 1000


def test_union_pads_by_position(left3, right5):
    both = rel.union_rows(left3, right5, right_cols={"k": "key", "t": "t", "y": "y", "n": "n"})
    assert both.columns == ["key", "t", "n", "y"]
    assert both.count() == 9
    assert both.where("y is null").count() == 5
    assert rel.union_rows(left3, left3).count() == 10


def test_union_of_text_and_numbers(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2.5, True)], "t string, d double, f boolean")
    assert rows(rel.union_rows(a, b)) == [("1", "x", None), ("y", "2.5", True)]


def test_distinct(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 9, "z"), (1, 5, "w")],
                               "k int, v int, s string")
    first = rel.distinct(df, "k", [("v", "desc"), ("s", "asc")])
    assert rows(first) == [(1, 5, "w"), (2, 9, "z")]
    assert rel.distinct(df, ["k", "v"]).count() == 3
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_group_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 2), ("b", 5.0, None)],
                               "k string, `x.y` double, z int")
    grouped = rel.group_agg(df, "k", [("x.y", "mean"), ("x.y", "average", "m"), ("*", "count"),
                                      ("z", "countDistinct"), ("z", "size", "n")])
    assert grouped.columns == ["k", "x.y_mean", "m", "count", "z_countDistinct", "n"]
    assert rows(grouped) == [("a", 2.0, 2.0, 2, 1, 2), ("b", 5.0, 5.0, 1, 0, 0)]
    with pytest.raises(ValueError):
        rel.group_agg(df, "k", [("*", "sum")])


def test_pivot_and_features(spark):
    df = spark.createDataFrame([("a", 1, "u", 1.0), ("a", 2, "v", 2.0), (None, 1, "u", 4.0)],
                               "s string, i int, p string, x double")
    assert rows(rel.pivot_agg(df, "s", "p", ["u", "v"], "x", "sum")) == [
        ("a", 1.0, 2.0), (None, 4.0, None)]
    # Text and numbers have no common type but text; NULL is a value.
    stacked = reshape.feature_agg(df, ["s", "i"], "p", ["v", "u"], "x", "max")
    assert stacked.columns == ["encode_feature", "v", "u"]
    assert rows(stacked) == [("1", None, 4.0), ("2", 2.0, None), ("a", 2.0, 1.0),
                             (None, None, 4.0)]
    assert stacked._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_feature_may_be_the_pivot_or_value(spark):
    df = spark.createDataFrame([("u", 1.0), ("v", 2.0)], "p string, x double")
    assert rows(reshape.feature_agg(df, ["p"], "p", ["u"], "x", "sum")) == [("u", 1.0), ("v", None)]
    assert reshape.feature_agg(df, ["x"], "p", ["u"], "x", "sum").count() == 2


def test_unpivot_and_back(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (2, None, 5)], "k int, `a.b` double, c int")
    long = reshape.unpivot(df, ["a.b", "c"], "v")
    assert long.columns == ["k", "v"] and long.count() == 4
    named = reshape.unpivot(df, ["a.b", "c"], "v", name_col="name")
    back = rel.pivot_agg(named, "k", "name", ["a.b", "c"], "v", "max")
    assert rows(back) == [(1, 2.0, 3.0), (2, None, 5.0)]


def test_explode(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, v array<string>")
    assert rows(reshape.explode(df, "v")) == [(1, "a"), (1, "b")]
    assert reshape.explode(df, "v", outer=True).count() == 4


def test_sort(spark):
    df = spark.createDataFrame([(i % 2, i % 3, i % 5, i % 7, i % 11, i) for i in range(60)],
                               "a int, b int, c int, d int, e int, f int")
    keys = [("e", "desc"), ("a", "asc"), ("b", "desc"), ("c", "asc"), ("d", "desc"), ("f", "asc")]
    got = [tuple(r) for r in rel.order_by(df, keys).collect()]
    want = sorted(got, key=lambda r: (-r[4], r[0], -r[1], r[2], -r[3], r[5]))
    assert got == want
    plan = rel.order_by(df, keys, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError, match="upwards"):
        rel.order_by(df, [("a", "upwards")])


def test_sql(spark, left3, right5):
    got = rel.sql_query("select s, n from {0} l join {1} r on l.k = r.k where n > {2}.low"
                        .replace("{2}.low", "10"), left3, right5)
    assert rows(got) == [("a", 20), ("b", 20)]
    views = {t.name for t in spark.catalog.listTables()}
    rel.sql_query("select 1 as one from {0}", left3).collect()
    assert {t.name for t in spark.catalog.listTables()} == views
    braces = rel.sql_query(r"select max(regexp_extract('ab12345', '[0-9]{5}', 0)) as r, "
                           "'{\"k\": {1}}' as j from {0}", left3)
    assert tuple(braces.first()) == ("12345", '{"k": {1}}')
    with pytest.raises(ValueError):
        rel.sql_query("select 1")


def test_row_index_with_ties(spark):
    df = spark.range(1000, numPartitions=6).select((F.col("id") % 3).alias("k"), F.lit("x").alias("s"))
    got = row_index(df, "k").collect()
    assert sorted(r["index"] for r in got) == list(range(1000))
    assert all(a["k"] <= b["k"] for a, b in zip(*(lambda s: (s, s[1:]))(
        sorted(got, key=lambda r: r["index"]))))


def test_row_index_with_vectors_and_maps(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(i % 2, Vectors.dense(i), {"a": i}) for i in range(20)],
                               ["k", "v", "m"])
    got = row_index(df, [("k", "desc_nulls_last")]).collect()
    assert sorted(r["index"] for r in got) == list(range(20))
    assert {r["v"][0] for r in got} == {float(i) for i in range(20)}
    assert all((r["k"] == 1) == (r["index"] < 10) and r["m"]["a"] == r["v"][0] for r in got)


def test_prefix_sums(spark):
    df = spark.range(500, numPartitions=5).select((F.col("id") * 37 % 500).alias("k"),
                                                  (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, [("k", "desc")], {"upto": "v"}, totals=True).collect()
    total = 0
    for row in sorted(got, key=lambda r: -r["k"]):
        total += row["v"]
        assert row["upto"] == total
    assert {r["upto_total"] for r in got} == {total}


def test_zip_columns(spark):
    left = spark.range(23, numPartitions=4).select((22 - F.col("id")).alias("a"), F.lit(1).alias("c"))
    right = spark.range(40, numPartitions=3).select(F.col("id").alias("a"))
    got = zip_columns(left, right, "a", [("a", "desc")], right_cols=[("a", "b")])
    assert got.columns == ["a", "c", "b"]
    assert rows(got) == sorted([(i if i < 23 else None, 1 if i < 23 else None, 39 - i)
                                for i in range(40)], key=repr)


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert row_index(empty, "x").count() == 0
    assert zip_columns(empty, empty.select(F.col("x").alias("y")), "x", "y").count() == 0
    assert rel.distinct(empty, "s", "x").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(weights=st.lists(st.integers(1, 9), min_size=1, max_size=4), seed=st.integers(0, 99))
def test_split_parts_are_the_input(spark, weights, seed):
    df = spark.range(300).withColumn("s", F.col("id").cast("string"))
    parts = sampling.random_split(df, weights, seed, key=["id", "s"])
    ids = [r["id"] for p in parts for r in p.collect()]
    assert sorted(ids) == list(range(300)) and len(parts) == len(weights)


def test_keyed_choice_ignores_partitioning(spark):
    df = spark.range(1000)
    once = rows(sampling.sample(df, 0.3, 5, key="id"))
    assert once == rows(sampling.sample(df.repartition(9), 0.3, 5, key="id"))
    assert 230 < len(once) < 370
    assert once != rows(sampling.sample(df, 0.3, 6, key="id"))


def test_sample_by(spark):
    df = spark.createDataFrame([(s, i) for s in ("a", "b", None, "c") for i in range(50)],
                               "s string, x int")
    got = sampling.sample_by(df, "s", {"a": 1.0, "b": 0.0}, seed=1)
    assert {r["s"] for r in got.collect()} == {"a"} and got.count() == 50
    numbers = spark.range(10).withColumn("d", F.col("id").cast("double"))
    assert sampling.sample_by(numbers, "d", {3.0: 1.0}, 1).count() == 1
    assert sampling.sample_by(numbers, "id", {"3": 1}, 1).count() == 1


def test_samples_with_replacement_and_ratio(spark):
    df = spark.range(1000)
    assert sampling.sample(df, 2.0, 3, with_replacement=True).count() > 1500
    a, b = sampling.random_split(df, 0.25, 3)
    assert a.count() + b.count() == 1000 and a.count() < b.count()
    x, y = sampling.split_by(df.withColumn("m", F.col("id") % 4), "m", [1, 3])
    assert x.count() == y.count() == 250


def test_keyed_draws_with_replacement(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    for mean in (0.0, 0.3, 4.0):
        drawn = sampling.sample(df, mean, seed=9, with_replacement=True, key="k")
        counts = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
        values = [counts.get(k, 0) for k in range(20_000)]
        average = sum(values) / len(values)
        spread = sum((v - average) ** 2 for v in values) / len(values)
        assert abs(average - mean) < 0.05 and abs(spread - mean) < 0.15
    again = sampling.sample(df.repartition(5), 4.0, seed=9, with_replacement=True, key="k")
    assert {r["k"]: r["count"] for r in again.groupBy("k").count().collect()} == counts
    assert drawn.columns == ["k"]
    with pytest.raises(ValueError, match="copies"):
        sampling.sample(df, 1e4, seed=9, with_replacement=True, key="k")
    steps = sampling.poisson_steps(500.0)
    assert steps == sorted(steps) and steps[-1] > 1 - 1e-9


def test_scratch_is_freed(spark, tmp_path):
    import os

    from millrace.util import scratch_freed
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    left, right = spark.range(50).toDF("a"), spark.range(60).toDF("b")
    with scratch_freed(spark):
        zip_columns(left, right, "a", [("b", "desc")]).write.parquet(str(tmp_path / "out"))
        assert set(os.listdir(base)) > before
        with scratch_freed(spark):
            row_index(left, "a").count()
    assert set(os.listdir(base)) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    with pytest.raises(RuntimeError), scratch_freed(spark):
        row_index(left, "a").count()
        raise RuntimeError
    assert set(os.listdir(base)) == before


def test_random_split_query_sorts_by_partition_of_the_session(spark, tmp_path):
    """The sorted partitions are as many as the session plans: a fixed number would grow with the table."""
    from millrace.plans import QUERIES
    spark.range(300, numPartitions=2).withColumnRenamed("id", "o_orderkey").write.parquet(
        str(tmp_path / "orders.parquet"))
    split = QUERIES["random_split"](spark, str(tmp_path))
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert f", {tasks}), REPARTITION_BY_NUM" in split._jdf.queryExecution().toString()
    assert tuple(split.first()) == (300, 0)
