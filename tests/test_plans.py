"""What Spark makes of the queries: scans, pushdown, and nothing that breaks at scale."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import profile as prof
from millrace.operators import relational as rel
from millrace.operators import reshape, stats
from millrace.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_and_no_python_rows(spark, name):
    plan = physical(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    if name != "join_cross":
        assert "BroadcastNestedLoopJoin" not in plan
    if not name.startswith(("hash_encode", "sql_dot")):
        assert "ArrowEvalPython" not in plan


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(QUERIES["filter_multi"](spark, FOLDER))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThan(l_quantity,10.0)" in pushed and "l_shipdate" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "l_tax" not in schema and "l_extendedprice" not in schema


def test_joins_read_only_what_they_use(spark):
    plan = physical(QUERIES["join_inner"](spark, FOLDER))
    assert "o_orderdate" not in plan and "c_name" not in plan


@pytest.mark.parametrize("make", [
    lambda df: reshape.unpivot(df, ["l_tax", "l_discount", "l_quantity"], "v"),
    lambda df: reshape.feature_agg(df, ["l_linenumber", "l_suppkey", "l_partkey"], "l_returnflag",
                                   ["A", "R"], "l_tax", "sum"),
    lambda df: stats.corr_matrix(df, ["l_tax", "l_discount", "l_quantity"]),
    lambda df: stats.cov_matrix(df, ["l_tax", "l_discount", "l_quantity"]),
    lambda df: stats.quantiles(df, ["l_tax", "l_discount", "l_quantity"], [0.5], 0.01),
    lambda df: prof.profile_stats(df, ["l_tax", "l_returnflag", "l_quantity"]),
    lambda df: prof.profile_histogram(df, ["l_tax", "l_returnflag", "l_quantity"],
                                      numbers="by_count"),
])
def test_one_scan(spark, make):
    assert optimized(make(lines(spark))).count("Relation [") == 1


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    first = rel.distinct(lines(spark), "l_returnflag", ["l_orderkey", "l_partkey"])
    assert physical(first).count("WindowGroupLimit") == 2
    grouped = rel.group_agg(lines(spark), "l_returnflag", [("l_tax", "sum")])
    assert "partial_sum" in physical(grouped)
    bars = physical(prof.profile_histogram(lines(spark), ["l_returnflag", "l_tax"],
                                           numbers="by_count"))
    assert "partial_count" in bars and bars.count("WindowGroupLimit") == 2


def test_hash_stays_in_one_batch_step(spark):
    coded = hashing.hash_encode(lines(spark), [("l_orderkey", 1), ("l_partkey", 2)], "code")
    assert physical(coded).count("ArrowEvalPython") == 1 and "Exchange" not in physical(coded)


def test_observing_keeps_the_plan_open(spark):
    watched, _ = prof.observe_counts(lines(spark.newSession()).select("l_orderkey", "l_tax"))
    schema = re.search(r"ReadSchema: struct<(.*?)>", physical(watched.where(F.col("l_tax") > 0)))
    assert "l_comment" not in schema.group(1) and schema.group(1).count(":") == 2


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from millrace import util

    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        util.scratch(Session, "x")
    assert util.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_models_score_after_a_frame_was_observed(spark):
    QUERIES["observe_counts"](spark, FOLDER).collect()
    assert QUERIES["logreg"](spark, FOLDER).first()["n_bad_labels"] == 0


def test_running_sums_need_no_shuffle_of_their_own(spark):
    """The rows are ranged and written; afterwards only totals of ranges are exchanged."""
    from millrace.operators.evaluate import roc_curve
    scored = lines(spark).select(F.col("l_tax").alias("score"), (F.col("l_quantity") > 25).cast("int")
                                 .alias("label"))
    plan = physical(roc_curve(scored, "score", "label"))
    assert "hashpartitioning(_part" in plan and "Window" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning(_part" in line:
            assert "threshold" not in line
    assert plan.count("Exchange hashpartitioning") == 1


def test_hashing_checks_keep_vectors_sparse(spark, tmp_path):
    """Only slots that a vector holds become rows: a dense one has as many for each word as slots."""
    from millrace.plans import features
    words = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["c"])], "doc_id int, w array<string>")
    counted = features.fe.hashing_tf(words, "w", "tf", numFeatures=128)
    stored = features._stored(counted, ["doc_id"], "tf", "n")
    dense = features._slots(counted, ["doc_id"], "tf", name="n").where("n <> 0")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, dense.collect()))


def test_feature_hash_checks_rows_that_came_out_alike_once(spark, tmp_path):
    from millrace.plans import QUERIES
    from pyspark.sql import functions as F
    i = F.col("id")
    spark.range(2000, numPartitions=2).select(
        (i % 5).cast("double").alias("l_quantity"), (i % 2 / 10).alias("l_tax"),
        F.element_at(F.array(*map(F.lit, "ANR")), (i % 3 + 1).cast("int")).alias("l_returnflag"),
        (i % 7).cast("int").alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    checked = QUERIES["feature_hash"](spark, str(tmp_path))
    assert "rows" in checked._jdf.queryExecution().analyzed().toString()
    assert tuple(checked.first())[:3] == (2000, 0, 0)
