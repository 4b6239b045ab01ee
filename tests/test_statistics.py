import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import evaluate as ev
from millrace.operators import profile as prof
from millrace.operators import stats


def frame(spark, values, schema="x double"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_matrices(spark):
    df = spark.createDataFrame([(1.0, 2, 5.0), (2.0, 1, None), (4.0, 7, 1.0), (5.0, 3, 2.0)],
                               "`a.b` double, b int, c double")
    got = stats.corr_matrix(df, ["a.b", "b", "c"]).collect()
    assert [r["Columns"] for r in got] == ["a.b", "b", "c"]
    m = np.array([list(r)[1:] for r in got])
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 1.0)
    assert math.isclose(m[0][1], np.corrcoef([1, 2, 4, 5], [2, 1, 7, 3])[0][1])
    assert math.isclose(m[0][2], np.corrcoef([1, 4, 5], [5, 1, 2])[0][1])
    zero = np.array([list(r)[1:] for r in stats.cov_matrix(df, ["b", "c"], True).collect()])
    assert np.allclose(zero, np.cov([2, 1, 7, 3], [5, 0, 1, 2]))


def test_matrix_is_one_aggregation(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(12)])
    plan = stats.cov_matrix(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Range (") == 1


def test_describe(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None)], "`x.y` double, s string")
    got = {r["summary"]: (r["x.y"], r["s"]) for r in stats.describe(df, ["x.y", "s"]).collect()}
    assert got["count"] == ("2", "2") and got["mean"] == ("2.0", None)
    assert got["min"] == ("1.0", "a") and got["max"] == ("3.0", "b")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60),
       st.lists(st.sampled_from([0.0, 0.1, 0.3, 0.5, 0.7, 0.99, 1.0]), min_size=1, max_size=4))
def test_exact_quantiles(spark, values, probabilities):
    got = stats.quantiles(frame(spark, [float(v) for v in values]), "x", probabilities).collect()
    ordered = sorted(values)
    want = [(p, float(ordered[max(math.ceil(round(p * len(values), 9)), 1) - 1]))
            for p in probabilities]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_exact_quantiles_when_the_sketch_is_off(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"))
    want = [(0.1, 99.0), (0.5, 499.0), (1.0, 999.0)]
    probabilities = [p for p, _ in want]
    assert [tuple(r) for r in stats.quantiles(df, "x", probabilities).collect()] == want
    for bands in ([(0.0, 10.0), (500.0, 600.0)], [(120.0, 130.0)], [(99.0, 99.0), (600.0, 999.0)]):
        monkeypatch.setattr(stats, "_bands", lambda *_: {"_x0": bands})
        assert [tuple(r) for r in stats.quantiles(df, "x", probabilities).collect()] == want


def test_quantiles_leave_out_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None), (None, None), (3.0, 5)],
                               "x double, i int")
    for error in (0.0, 0.01):
        got = stats.quantiles(df, ["x", "i"], [0.5, 1.0], error)
        assert got.columns == ["quantiles", "x", "i"]
        assert sorted(tuple(r) for r in got.collect()) == [(0.5, 1.0, 1.0), (1.0, 3.0, 5.0)]
    part = stats.quantiles(df.withColumn("none", F.lit(None).cast("double")), ["x", "none"], [1.0])
    assert tuple(part.first()) == (1.0, 3.0, None)
    with pytest.raises(ValueError):
        stats.quantiles(df, ["x"], [1.5])


def test_frequent_items(spark):
    df = spark.createDataFrame([(i % 2, "a" if i < 7 else f"r{i}") for i in range(10)],
                               "i int, s string")
    row = stats.freq_items(df, ["i", "s"], 0.5, exact=True).first()
    assert row["i_freqItems"] == [0, 1] and row["s_freqItems"] == ["a"]
    sketch = stats.freq_items(df, ["i", "s"], 0.5).first()
    assert set(sketch["i_freqItems"]) >= {0, 1} and "a" in sketch["s_freqItems"]


def report(df, columns, **options):
    reports = prof.profile(df, columns, numbers="by_count", **options)
    return {r["column"]: json.loads(r["vis"]) for r in reports.collect()}


def test_profile(spark):
    df = spark.createDataFrame(
        [(float(i), i % 3, "" if i == 0 else "abc"[i % 3], i % 2 == 0, [i]) for i in range(30)]
        + [(None, None, None, None, None), (float("nan"), 1, "a", True, [])],
        "x double, i int, s string, b boolean, v array<int>")
    got = report(df, ["s", "x", "i", "b", "v"], exact=True)
    assert list(got) == ["s", "x", "i", "b", "v"]
    x = {s["name"]: s["value"] for s in got["x"]["statistics"]}
    assert x["count"] == "30" and x["countmissing"] == "2" and x["mean"] == "14.5"
    assert float(x["variance"]) == pytest.approx(np.var(range(30)))
    assert x["columntype"] == "Numeric Feature"
    assert got["x"]["histogram"]["y"] == [3] * 10
    assert got["x"]["histogram"]["x"][0] == "0.0-2.9"
    assert got["i"]["histogram"] == {"x": ["1", "0", "2"], "y": [11, 10, 10]}
    s = {t["name"]: t["value"] for t in got["s"]["statistics"]}
    assert s["count"] == "32" and s["countmissing"] == "2" and s["countdistinct"] == "4"
    assert got["s"]["histogram"] == {"x": ["a", "b", "c"], "y": [10, 10, 10]}
    assert got["b"]["histogram"]["x"] == ["true", "false"]
    assert got["v"] == {"name": "v", "statistics": [], "histogram": {"x": [], "y": []}}


def test_profile_of_nothing_and_of_constants(spark):
    empty = spark.createDataFrame([], "x double, s string")
    got = report(empty, ["x", "s"])
    assert got["x"]["histogram"]["x"] == [] and got["s"]["statistics"][0]["value"] == "0"
    constant = report(frame(spark, [2.5] * 4), ["x"])
    assert constant["x"]["histogram"] == {"x": ["2.5"], "y": [4]}


def test_histogram_shows_empty_buckets(spark):
    df = frame(spark, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 100.0, float("nan")])
    bars = prof.profile_histogram(df, ["x"], numbers="by_count").orderBy("position").collect()
    assert [r["y"] for r in bars] == [11, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_preview(spark):
    df = spark.createDataFrame([(1, 2.5, "x", True, ["a", None], (7,)), (2, None, None, None, None,
                                                                         None)],
                               "i int, d double, s string, b boolean, a array<string>, "
                               "t struct<z:int>")
    got = [tuple(r) for r in prof.preview(df, 10, "i").collect()]
    assert got == [("1", "2.5", "x", "true", "[a,null]", '{"z":7}'),
                   ("2", "null", "null", "null", "null", "null")]


def test_schema_as_json(spark):
    df = spark.createDataFrame([(1, ["a"])], "i int, `a.b` array<string>")
    assert json.loads(prof.schema_json(df))["fields"][1] == {
        "name": "a.b", "type": "array<string>", "nullable": True}


def test_pages(spark):
    df = spark.range(250)
    pages = [[r["id"] for r in prof.page(df, [("id", "desc")], n, 30, within=100).collect()]
             for n in range(1, 6)]
    assert pages[0][0] == "249" and [len(p) for p in pages] == [30, 30, 30, 10, 0]
    assert sum(pages, []) == [str(i) for i in range(249, 149, -1)]
    assert prof.page_count(df, 30, within=100) == 4


def test_observed_counts(spark):
    df = spark.newSession().createDataFrame([(1, None), (2, "x"), (None, None)],
                                            "a int, s string")
    watched, seen = prof.observe_counts(df)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "a_nulls": 1, "s_nulls": 2}


SCORES = [(0.9, 1), (0.8, 1), (0.8, 0), (0.5, 0), (0.5, 1), (0.2, 0)]


def scored(spark, data):
    return spark.createDataFrame([(float(s), float(y)) for s, y in data], "score double, label double")


def test_binary_measures_by_brute_force(spark):
    df = scored(spark, SCORES)
    row = ev.eval_binary(df, "score", "label", bins=100).first()
    pos = [s for s, y in SCORES if y]
    neg = [s for s, y in SCORES if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert row["areaUnderROC"] == pytest.approx(wins / len(pos) / len(neg))
    points = sorted({s for s, _ in SCORES}, reverse=True)
    curve = [(sum(y for s, y in SCORES if s >= t) / 3,
              sum(y for s, y in SCORES if s >= t) / sum(s >= t for s, _ in SCORES)) for t in points]
    area, before = 0.0, (0.0, curve[0][1])
    for point in curve:
        area += (point[0] - before[0]) * (point[1] + before[1]) / 2
        before = point
    assert row["areaUnderPR"] == pytest.approx(area)
    result = json.loads(row["evaluate_result"])
    assert [c["title"] for c in result["charts"]] == [
        "ROC", "PR", "F1 Score by Threshold", "Precision by Threshold", "Recall by Threshold"]
    assert result["charts"][0]["data"][0]["x"][0] == 0.0
    assert result["charts"][2]["data"][0]["x"] == points


def test_areas_match_spark(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = spark.range(3000).select(((F.col("id") * 7919) % 613 / 613.0).alias("score"),
                                  ((F.col("id") * 31) % 5 < (F.col("id") * 7919) % 613 / 150)
                                  .cast("double").alias("label"))
    row = ev.eval_binary(df, "score", "label", bins=100).first()
    for metric in ev.BINARY_METRICS:
        theirs = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=metric,
                                               numBins=0).evaluate(df)
        assert row[metric] == pytest.approx(theirs, abs=1e-9)


def test_one_sided_labels(spark):
    only = ev.eval_binary(scored(spark, [(0.3, 1), (0.7, 1)]), "score", "label", bins=9).first()
    assert only["areaUnderPR"] == 1.0 and only["areaUnderROC"] == 0.0
    none = ev.threshold_curve(scored(spark, [(0.3, 0)]), "score", "label").first()
    assert tuple(none) == (0.3, 0.0, 0.0, 0.0)


def test_thinned_curve_is_part_of_the_exact_one(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("score"),
                                  (F.col("id") % 3 == 0).cast("double").alias("label"))
    exact = {tuple(r) for r in ev.roc_curve(df, "score", "label").collect()}
    thin = {tuple(r) for r in ev.roc_curve(df, "score", "label", bins=50).collect()}
    assert thin <= exact and 50 <= len(thin) <= 54


def test_vector_scores(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense(1 - s, s), int(y)) for s, y in SCORES],
                               ["probability", "label"])
    assert ev.eval_binary(df, "probability", "label", bins=9).first()["areaUnderROC"] == pytest.approx(
        ev.eval_binary(scored(spark, SCORES), "score", "label", bins=9).first()["areaUnderROC"])


def test_multiclass_matches_spark(spark):
    from pyspark.mllib.evaluation import MulticlassMetrics
    data = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (7.0, 7.0), (9.0, 1.0)]
    df = spark.createDataFrame(data, "prediction double, label double")
    row = ev.eval_multiclass(df, "prediction", "label", matrix=True).first()
    theirs = MulticlassMetrics(spark.sparkContext.parallelize(data))
    for ours, other in [("accuracy", theirs.accuracy),
                        ("weightedFalsePositiveRate", theirs.weightedFalsePositiveRate),
                        ("weightedTruePositiveRate", theirs.weightedTruePositiveRate),
                        ("weightedFMeasure", theirs.weightedFMeasure()),
                        ("weightedPrecision", theirs.weightedPrecision),
                        ("weightedRecall", theirs.weightedRecall)]:
        assert row[ours] == pytest.approx(other), ours
    matrix = json.loads(row["evaluate_result"])["confusionMatrix"]
    assert matrix["classNames"] == ["1.0", "3.0", "7.0"]
    assert matrix["data"] == [[1.0, 1.0, 0.0], [0.0, 1.0, 1.0], [0.0, 0.0, 2.0]]


def test_regression_matches_spark(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (4.0, 4.5), (8.0, 7.0)],
                               "prediction double, label double")
    row = ev.eval_regression(df, "prediction", "label").first()
    for name, metric in [("explainedVariance", "var"), ("meanAbsoluteError", "mae"),
                         ("meanSquaredError", "mse"), ("rootMeanSquaredError", "rmse"),
                         ("r2", "r2")]:
        assert row[name] == pytest.approx(RegressionEvaluator(metricName=metric).evaluate(df))
    assert json.loads(row["evaluate_result"])["metrics"][4]["name"] == "r2"
    assert ev.evaluate(df, "regression", "prediction", "label").first() == row
    with pytest.raises(ValueError):
        ev.eval_regression(df, "nothing", "label")
    with pytest.raises(ValueError):
        ev.evaluate(df, "ranking", "prediction", "label")


def test_matrix_of_many_classes(spark):
    df = spark.range(1200).select(F.col("id").cast("double").alias("label"),
                                  (F.col("id") % 4).cast("double").alias("prediction"))
    row = ev.eval_multiclass(df, "prediction", "label", matrix=True).first()
    assert row["accuracy"] == pytest.approx(4 / 1200)
    matrix = json.loads(row["evaluate_result"])["confusionMatrix"]["data"]
    assert len(matrix) == 1200 and all(line[i % 4] == sum(line) == 1 for i, line in enumerate(matrix))
    without = ev.eval_multiclass(df, "prediction", "label", matrix=False).first()
    assert "confusionMatrix" not in json.loads(without["evaluate_result"])


def test_infinite_values_have_no_ranges(spark):
    df = spark.range(100).select(F.when(F.col("id") == 3, float("inf"))
                                 .otherwise(F.col("id")).alias("x"))
    with pytest.raises(ValueError):
        prof.profile_histogram(df, "x", numbers="ranges")
    assert prof.profile_histogram(df, "x", numbers="values").count() == 10
    assert prof.profile_histogram(df.where("x < 5"), "x", numbers="ranges").count() == 10


def test_deep_pages(spark):
    df = spark.range(1000)
    assert [int(r["id"]) for r in prof.page(df, ["id"], 90, 11).collect()] == list(range(979, 990))
    assert prof.page_count(df, 11) == 91


def test_page_directory(spark):
    from millrace.operators.pages import PageDirectory
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(1000)], "k int, v double").repartition(4)
    pages = PageDirectory(df, [("k", "desc"), "v"])
    want = sorted(((i % 7, float(i)) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert len(pages) == 1000 and pages.page_count(11) == 91 and pages.page_count(11, within=30) == 3
    for number in (1, 2, 45, 90, 91):
        got = [(int(r["k"]), float(r["v"])) for r in pages.page(number, 11).collect()]
        assert got == want[(number - 1) * 11:number * 11]
    assert pages.page(3, 11, within=30).count() == 8
    assert pages.page(92, 11).count() == 0 and pages.page(4, 11, within=30).count() == 0
    assert [r["v"] for r in pages.page(1, 1000).collect()] == [str(v) for _, v in want]
    plan = pages.page(91, 11)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "PartitionFilters: [isnotnull(_part" in plan
    empty = PageDirectory(df.limit(0), ["v"])
    assert len(empty) == 0 and empty.page(1, 5).count() == 0 and empty.page_count(5) == 0
    same = PageDirectory(spark.createDataFrame([(1,)] * 50, "k int").repartition(4), ["k"])
    assert same.page(2, 30).count() == 20


def test_running_sums_are_carried(spark):
    from millrace.operators.ordering import prefix_sums
    rows_ = [(i, None if i % 5 == 0 else i - 40, None if i % 3 == 0 else i / 8) for i in range(300)]
    df = spark.createDataFrame(rows_, "k int, n int, x double").repartition(5)
    got = prefix_sums(df, [("k", "desc")], {"a": "n", "b": "x"}, totals=True)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    a = b = 0
    total_a, total_b = (sum(r[i] or 0 for r in rows_) for i in (1, 2))
    for row in sorted(got.collect(), key=lambda r: -r["k"]):
        a, b = a + (row["n"] or 0), b + (row["x"] or 0)
        assert (row["a"], row["b"], row["a_total"], row["b_total"]) == (a, b, total_a, total_b)
    assert dict(got.dtypes)["a"] == "bigint" and dict(got.dtypes)["b"] == "double"
    big = spark.createDataFrame([(1, 2**62), (2, 2**62), (3, 2**62)], "k int, n bigint")
    with pytest.raises(Exception, match="too large|overflow"):
        prefix_sums(big.coalesce(1), ["k"], {"a": "n"}).collect()


@pytest.mark.parametrize("n_rows,null_every,zero", [(500, 6, False), (500, 4, True), (1, 9, False),
                                                    (3, 2, False), (0, 2, False)])
def test_wide_matrices_match_the_built_in(spark, monkeypatch, n_rows, null_every, zero):
    monkeypatch.setattr(stats, "_WIDE", 0)
    rng = np.random.default_rng(5)
    data = [[None if (i * 3 + j * j) % null_every == 0 else float(1e6 + (j + 1) * rng.normal())
             for j in range(6)] for i in range(n_rows)]
    df = spark.createDataFrame(data, ", ".join(f"`x.{j}` double" for j in range(6))).repartition(4)
    names = df.columns
    filled = df.fillna(0.0) if zero else df
    quoted = {c: F.col(f"`{c}`") for c in names}
    for ours, theirs in ((stats.corr_matrix, F.corr), (stats.cov_matrix, F.covar_samp)):
        got = {r["Columns"]: r for r in ours(df, names, null_as_zero=zero).collect()}
        want = filled.agg(*[theirs(quoted[a], quoted[b]).alias(f"{a}|{b}")
                            for a in names for b in names]).first()
        for a in names:
            for b in names:
                value = want[f"{a}|{b}"]
                if ours is stats.corr_matrix and a == b:
                    value = 1.0
                if value is None or np.isnan(value):
                    assert got[a][b] is None or np.isnan(got[a][b])
                else:
                    assert got[a][b] == pytest.approx(value, rel=1e-7, abs=1e-7)


def test_wide_matrices_have_a_small_plan(spark):
    wide = spark.range(200).select([(F.col("id") * (i + 1) % 97).cast("double").alias(f"c{i}")
                                    for i in range(500)])
    found = stats.corr_matrix(wide, wide.columns)
    assert len(found.columns) == 501 and found.count() == 500


def test_states_merge_to_the_profile_of_the_whole(spark):
    from millrace.operators import sketches
    rng = np.random.default_rng(2)
    data = [(i % 5, None if i % 11 == 0 else float(rng.normal()), "" if i % 7 == 0 else f"s{i % 40}",
             [i]) for i in range(4000)] + [(9, float("nan"), None, None)]
    df = spark.createDataFrame(data, "p int, x double, s string, v array<int>").repartition(3)
    parts = sketches.profile_state(df, ["x", "s", "v"], by=["p"])
    assert parts.count() == 12 and parts.columns[0] == "p"
    twice = sketches.merge_states(parts.where("p < 2").drop("p").unionByName(sketches.merge_states(
        parts.where("p >= 2").drop("p"))))
    got = {r["column"]: r for r in sketches.state_stats(twice).collect()}
    want = {r["column"]: r for r in prof.profile_stats(df, ["x", "s", "v"], exact=True).collect()}
    assert set(got) == set(want) == {"x", "s"}
    for c in got:
        for field in ("kind", "count", "min", "max", "mean", "stddev", "variance", "countmissing"):
            a, b = got[c][field], want[c][field]
            assert a == b or a == pytest.approx(b, rel=1e-9), (c, field)
        assert abs(got[c]["countdistinct"] - want[c]["countdistinct"]) <= 0.08 * want[c]["countdistinct"]
    values = sorted(r[1] for r in data if r[1] is not None and r[1] == r[1])
    for r in sketches.state_quantiles(twice, [0.0, 0.1, 0.5, 1.0]).collect():
        rank = np.searchsorted(values, r["value"]) / len(values)
        assert abs(rank - r["quantile"]) < 0.03
    ranges = sorted(sketches.state_ranges(twice, 4).collect(), key=lambda r: r["position"])
    edges = [r["low"] for r in ranges] + [ranges[-1]["high"]]
    assert edges == pytest.approx(list(np.linspace(values[0], values[-1], 5)))
    bars = np.histogram(values, edges)[0]
    assert all(abs(r["y"] - b) < 0.04 * len(values) for r, b in zip(ranges, bars))
    assert sum(r["y"] for r in ranges) == pytest.approx(len(values), abs=3)
    empty = sketches.merge_states(sketches.profile_state(df.limit(0), ["x", "s"]))
    assert {r["column"]: r["count"] for r in sketches.state_stats(empty).collect()} == {"x": 0, "s": 0}
    assert sketches.state_quantiles(empty, [0.5]).count() == 0


def test_ranges_need_no_distinct_counts(spark, monkeypatch):
    """Ranges follow from the least and the largest value, or from statistics at hand."""
    df = spark.createDataFrame([(float(i % 50), i) for i in range(500)], "x double, k int")
    want = sorted(map(tuple, prof.profile_histogram(df, ["x", "k"], exact=True, numbers="by_count").collect()))
    stats = prof.profile_stats(df, ["k", "x"]).persist()

    def counted(*_):
        raise AssertionError("distinct values are counted")
    for name in ("count_distinct", "approx_count_distinct"):
        monkeypatch.setattr(prof.F, name, counted)
    assert sorted(map(tuple, prof.profile_histogram(df, ["x", "k"], exact=True, numbers="ranges").collect())) == want
    monkeypatch.setattr(prof, "_stats", counted)
    assert sorted(map(tuple, prof.profile_histogram(df, ["x", "k"], numbers="ranges", stats=stats).collect())) == want


def test_exact_statistics_expand_no_other_cell(spark):
    """The rows that are made for distinct counts carry no sums; all counts are right."""
    df = spark.createDataFrame([(float(i % 50), i % 7, "ab"[i % 2]) for i in range(500)], "x double, k int, s string")
    found = prof.profile_stats(df, ["x", "k", "s"], exact=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    lines = [line for line in plan.splitlines() if "Aggregate" in line and "stddev" in line]
    assert lines and not any("gid" in line for line in lines)
    assert {r["column"]: (r["count"], r["countdistinct"]) for r in found.collect()} == {
        "x": (500, 50), "k": (500, 7), "s": (500, 2)}
