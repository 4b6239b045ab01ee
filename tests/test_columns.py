import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import columns as ops
from millrace.operators import missing


@pytest.fixture(scope="module")
def dotted(spark):
    return spark.createDataFrame([(1, 1.5, "x", 7), (2, None, "y", 8)],
                                 "k int, `a.b` double, `a:b` string, `a``b` int")


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(1.0, 1.0, 1, Decimal("1.50"), "x", True), (None, None, None, None, None, None),
            (float("nan"), float("nan"), 3, Decimal("2.00"), "", False)]
    return spark.createDataFrame(rows, "a double, b float, c int, d decimal(10,2), e string, "
                                       "f boolean").withColumn(
        "g", F.lit("2024-01-01").cast("timestamp"))


def test_names_with_special_characters(dotted):
    df = ops.rename(dotted, [("a.b", "x.y"), ("a`b", "z`z")])
    assert df.columns == ["k", "x.y", "a:b", "z`z"]
    assert ops.select_as(dotted, {"a:b": "t", "a.b": "u"}).columns == ["u", "t"]
    merged = ops.merge_cols(dotted, ["a.b", "a:b", "a`b"], "m", "-", keep=False)
    assert [tuple(r) for r in merged.orderBy("k").collect()] == [(1, "1.5-x-7"), (2, "y-8")]
    assert missing.fillna(dotted, {"a.b": 0}).orderBy("k").collect()[1]["a.b"] == 0.0
    assert missing.dropna(dotted, ["a.b", "a`b"], "any").count() == 1
    assert ops.cast(dotted, {"a`b": "string"}).dtypes[3] == ("a`b", "string")


def test_cast_gives_null_and_keeps_the_whole_part(spark):
    df = spark.createDataFrame([("12",), ("1.9",), ("-3.",), ("1.5.2",), ("x",), ("",), (None,),
                                ("99999999999",)], "s string")
    cast = ops.cast(df, {"s": "int"})
    assert [r["s"] for r in cast.collect()] == [12, 1, -3, None, None, None, None, None]
    for target in ("double", "decimal(5,1)", "date", "timestamp", "boolean"):
        assert ops.cast(df, {"s": target}).where("s is null").count() >= 2
    numbers = ops.cast(spark.createDataFrame([("1e3",), ("Infinity",), ("nan",)], "s string"),
                       {"s": "double"})
    values = [r["s"] for r in numbers.collect()]
    assert values[0] == 1000.0 and math.isinf(values[1]) and math.isnan(values[2])
    with pytest.raises(Exception):
        ops.cast(df, {"s": "int"}, strict=True).collect()


def test_split(spark):
    df = spark.createDataFrame([("a1b22c",), ("z",), (None,)], "s string")
    wide = ops.split_col(df, "s", r"\d+", num=4)
    assert wide.columns == ["s", "s_0", "s_1", "s_2", "s_3"]
    assert tuple(wide.first()) == ("a1b22c", "a", "b", "c", None)
    assert ops.split_col(df, "s", r"\d+", keep=False).columns == ["s_split"]


def test_literal_and_expression(spark):
    df = ops.with_expr(ops.with_lit(spark.range(3), "v", "7"), "w", "id * 2 + int(v)")
    assert [tuple(r) for r in df.collect()] == [(0, "7", 7), (1, "7", 9), (2, "7", 11)]


def test_partitions(spark):
    df = spark.range(100)
    assert ops.repartition(df, 7).rdd.getNumPartitions() == 7
    assert ops.repartition(ops.repartition(df, 7), 3, shuffle=False).rdd.getNumPartitions() == 3
    ids = [r["id2"] for r in ops.with_id(ops.repartition(df, 5), "id2").collect()]
    assert len(set(ids)) == 100
    with pytest.raises(ValueError):
        ops.repartition(df, 0)


def test_fill(holes):
    filled = missing.fillna(holes, [("a", "9"), ("b", 9), ("c", "8"), ("d", "3.25"), ("e", "none"),
                                    ("f", "true"), ("nothing", 1)])
    rows = [tuple(r)[:6] for r in filled.collect()]
    assert rows[1] == (9.0, 9.0, 8, Decimal("3.25"), "none", True)
    assert rows[2] == (9.0, 9.0, 3, Decimal("2.00"), "", False)
    assert filled.columns == holes.columns and filled.dtypes == holes.dtypes
    with pytest.raises(ValueError, match="column g"):
        missing.fillna(holes, {"g": "2024-01-01"})


def test_drop(holes):
    some = holes.select("a", "b", "c")
    assert missing.dropna(some, ["a", "b", "c"], "any").count() == 1
    assert missing.dropna(some, ["a", "b", "c"], "all").count() == 2
    assert missing.dropna(some, ["a", "b", "c"], 3).count() == 2
    assert missing.dropna(some, ["a", "b", "c"], "2").count() == 1
    with pytest.raises(ValueError):
        missing.dropna(some, ["a"], "some")


def test_impute(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (None, 4.0), (4, None)],
                               "i int, x double")
    mean = missing.impute(df, ["i", "x"])
    assert mean.columns == ["i", "x", "i_I", "x_I"]
    assert [r["i_I"] for r in mean.collect()] == [1.0, 2.0, 7 / 3, 4.0]
    assert [r["x_I"] for r in mean.collect()] == [1.0, 2.5, 4.0, 2.5]
    with pytest.raises(ValueError):
        missing.impute(df, ["x"], "mode")


def test_impute_takes_the_exact_median(spark):
    n = 200_001
    df = spark.range(n).select((F.col("id") * 7 % n).cast("float").alias("x"), F.col("id").alias("i"))
    holes = df.unionByName(spark.createDataFrame([(None, None), (float("nan"), -1)],
                                                 "x float, i long"))
    filled = missing.impute(holes, ["x", "i"], "median").where("x is null or isnan(x)")
    assert sorted((r["x_I"], r["i_I"]) for r in filled.collect()) == [(1e5, -1.0), (1e5, 99999.0)]
    assert filled.schema["x_I"].dataType.simpleString() == "float"
    with pytest.raises(ValueError, match="no values"):
        missing.impute(holes.where("x is null"), ["x"], "median")


def test_unknown_columns_fail_at_once(spark):
    df = spark.range(1)
    for call in (lambda: ops.merge_cols(df, ["x"], "m", ","), lambda: ops.split_col(df, "x", ","),
                 lambda: missing.dropna(df, ["x"]), lambda: missing.impute(df, ["x"])):
        with pytest.raises(ValueError, match="no such column"):
            call()
