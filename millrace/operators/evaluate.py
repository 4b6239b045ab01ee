"""Quality of predictions: regression, binary and multiclass measures."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import prefix_sums
from millrace.util import check_columns, col, is_vector, require, written

REGRESSION_METRICS = ["explainedVariance", "meanAbsoluteError", "meanSquaredError",
                      "rootMeanSquaredError", "r2"]
BINARY_METRICS = ["areaUnderPR", "areaUnderROC"]
MULTICLASS_METRICS = ["accuracy", "weightedFalsePositiveRate", "weightedTruePositiveRate",
                      "weightedFMeasure", "weightedPrecision", "weightedRecall"]


def _result(metrics: list[str], **parts: Column) -> Column:
    """All measures of a row as one JSON text."""
    listed = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(m).alias("displayName"),
                                F.col(m).alias("value")) for m in metrics])
    return F.to_json(F.struct(listed.alias("metrics"),
                              *[value.alias(name) for name, value in parts.items()]))


def _no_charts() -> Column:
    return F.array().cast("array<string>")


def eval_regression(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row of regression measures and ``evaluate_result`` as JSON, from one pass.

    Rows with a missing prediction or label are left out.
    """
    check_columns(df, [prediction, label])
    scored = df.select(col(prediction).cast("double").alias("p"),
                       col(label).cast("double").alias("y")).dropna()
    error = F.col("y") - F.col("p")
    sums = scored.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        F.var_pop("y").alias("vy"), F.var_pop("p").alias("vp"),
        (F.avg("p") - F.avg("y")).alias("shift"))
    measured = sums.select(
        (F.col("vp") + F.col("shift") * F.col("shift")).alias("explainedVariance"),
        F.col("mae").alias("meanAbsoluteError"),
        F.col("mse").alias("meanSquaredError"),
        F.sqrt("mse").alias("rootMeanSquaredError"),
        (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"))
    return measured.withColumn("evaluate_result",
                               _result(REGRESSION_METRICS, charts=_no_charts()))


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives so far.

    Columns are ``threshold``, ``pos`` and ``neg`` of that score alone, ``tp``
    and ``fp`` for all scores at or above it, ``tp_total``, ``fp_total``, and
    the ``rank`` of the score with the number of scores ``rank_total``. The
    score is a number or a vector whose element 1 is used; a label above 0.5 is
    positive. Rows with the same score are merged before anything is ordered.
    """
    check_columns(df, [score, label])
    number = F.get(vector_to_array(col(score)), F.lit(1)) if is_vector(df, score) else col(score)
    scored = df.select(number.cast("double").alias("threshold"),
                       col(label).cast("double").alias("y")).dropna()
    positive = F.col("y") > 0.5
    merged = scored.groupBy("threshold").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"),
        F.lit(1).cast("bigint").alias("one"))
    return prefix_sums(merged, [("threshold", "desc")],
                       {"tp": "pos", "fp": "neg", "rank": "one"}, totals=True).drop("one")


def _chosen(bins: int) -> Column:
    """Every k-th score and the last one: at most about ``bins`` of the exact points."""
    require(bins > 0, "the number of bins must be positive")
    step = F.greatest(F.ceil(F.col("rank_total") / F.lit(bins)), F.lit(1))
    return (F.pmod(F.col("rank"), step) == 0) | (F.col("rank") == F.col("rank_total"))


def _thinned(counts: DataFrame, bins: int | None) -> DataFrame:
    return counts if bins is None else counts.where(_chosen(bins))


def _rates() -> dict[str, Column]:
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp_total")), F.lit(0.0))
    both = precision + recall
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.when(both > 0, F.lit(2.0) * precision * recall / both).otherwise(F.lit(0.0)),
        "fpr": F.coalesce(F.try_divide(F.col("fp"), F.col("fp_total")), F.lit(0.0)),
        "tpr": recall,
    }


def roc_curve(df: DataFrame, score: str, label: str, bins: int | None = None) -> DataFrame:
    """Points ``threshold``, ``fpr``, ``tpr``, with the corners (0,0) and (1,1)."""
    return _roc(score_counts(df, score, label), bins)


def _roc(counts: DataFrame, bins: int | None) -> DataFrame:
    rates = _rates()
    points = _thinned(counts, bins).select("threshold", rates["fpr"].alias("fpr"),
                                           rates["tpr"].alias("tpr"))
    corners = counts.sparkSession.createDataFrame([(None, 0.0, 0.0), (None, 1.0, 1.0)],
                                                  "threshold double, fpr double, tpr double")
    return points.unionByName(corners)


def pr_curve(df: DataFrame, score: str, label: str, bins: int | None = None) -> DataFrame:
    """Points ``threshold``, ``recall``, ``precision``, starting at recall 0."""
    counts = score_counts(df, score, label)
    return _pr(counts, bins)


def _pr(counts: DataFrame, bins: int | None) -> DataFrame:
    rates = _rates()
    point = F.struct(F.col("threshold"), rates["recall"].alias("recall"),
                     rates["precision"].alias("precision"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
                     rates["precision"].alias("precision"))
    chosen = F.lit(True) if bins is None else _chosen(bins)
    points = F.filter(F.array(F.when(F.col("rank") == 1, start), F.when(chosen, point)),
                      lambda p: p.isNotNull())
    return counts.select(F.inline(points))


def threshold_curve(df: DataFrame, score: str, label: str, bins: int | None = None) -> DataFrame:
    """``precision``, ``recall`` and ``f1`` at every threshold."""
    rates = _rates()
    return _thinned(score_counts(df, score, label), bins).select(
        "threshold", *[rates[n].alias(n) for n in ("precision", "recall", "f1")])


def _areas() -> dict[str, Column]:
    """Aggregates that add up the trapezoids between each score and the one above it."""
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(F.col("rank") == 1, precision).otherwise(
        F.try_divide(before_tp, before_tp + before_fp))
    width_pr = F.try_divide(F.col("pos"), F.col("tp_total"))
    width_roc = F.try_divide(F.col("neg"), F.col("fp_total"))
    height_roc = F.try_divide(before_tp + F.col("tp"), F.lit(2.0) * F.col("tp_total"))
    return {"areaUnderPR": F.coalesce(F.sum(width_pr * (precision + before) / 2), F.lit(0.0)),
            "areaUnderROC": F.coalesce(F.sum(width_roc * height_roc), F.lit(0.0))}


def eval_binary(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """Exact areas under the ROC and PR curves, and all curves as JSON.

    The JSON charts are thinned to about ``bins`` points each, which the caller
    chooses; the areas use every score (``roc_curve`` has all points). Both come
    from one aggregation over the scores.
    """
    rates = _rates()
    point = F.struct(F.col("rank").alias("k"), F.col("threshold").alias("t"),
                     *[rates[n].alias(n) for n in ("fpr", "tpr", "recall", "precision", "f1")])
    measured = score_counts(df, score, label).agg(
        *[area.alias(name) for name, area in _areas().items()],
        F.sort_array(F.collect_list(F.when(_chosen(bins), point))).alias("c"))

    def chart(title, x_name, y_name, x, y, first=None, last=None):
        xs, ys = F.col(f"c.{x}"), F.col(f"c.{y}")
        if first is not None:
            xs = F.concat(F.array(F.lit(first[0])), xs)
            ys = F.concat(F.array(F.lit(first[1]) if first[1] is not None else F.get(ys, F.lit(0))),
                          ys)
        if last is not None:
            xs, ys = F.concat(xs, F.array(F.lit(last[0]))), F.concat(ys, F.array(F.lit(last[1])))
        series = F.struct(F.lit("series 1").alias("name"), xs.alias("x"), ys.alias("y"))
        return F.struct(F.lit(title).alias("title"), F.lit("line").alias("type"),
                        F.lit(x_name).alias("xName"), F.lit(y_name).alias("yName"),
                        F.array(series).alias("data"))

    # Titles and axis names of the charts.
    drawn = F.array(
        chart("ROC", "False positive rate", "True positive rate", "fpr", "tpr",
              (0.0, 0.0), (1.0, 1.0)),
        chart("PR", "Recall", "Precision", "recall", "precision", (0.0, None)),
        chart("F1 Score by Threshold", "Threshold", "F1 Score", "t", "f1"),
        chart("Precision by Threshold", "Threshold", "Precision", "t", "precision"),
        chart("Recall by Threshold", "Threshold", "Recall", "t", "recall"))
    return measured.withColumn("charts", drawn).select(
        *BINARY_METRICS, _result(BINARY_METRICS, charts=F.col("charts")).alias("evaluate_result"))


def confusion_matrix(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """Rows per (``label``, ``prediction``) that occur, with real label values."""
    check_columns(df, [prediction, label])
    return (df.select(col(label).cast("double").alias("label"),
                      col(prediction).cast("double").alias("prediction")).dropna()
            .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")))


def eval_multiclass(df: DataFrame, prediction: str, label: str, *, matrix: bool) -> DataFrame:
    """One row of class-weighted measures and, with ``matrix``, the confusion matrix as JSON.

    The data is read once and reduced to one row per pair of classes. The JSON
    has a cell for every two classes, all in one row, so the caller says whether it
    is wanted; ``confusion_matrix`` is the table of those that occur.
    """
    cells = written(confusion_matrix(df, prediction, label), "confusion")
    n = F.col("count")
    hit = F.col("label") == F.col("prediction")
    actual = cells.groupBy("label").agg(F.sum(n).alias("size"),
                                        F.sum(F.when(hit, n).otherwise(0)).alias("tp"))
    guessed = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum(n).alias("guesses"))
    classes = actual.join(guessed, "label", "left").withColumns({
        "guesses": F.coalesce("guesses", F.lit(0)), "total": cells.agg(F.sum(n)).scalar()})
    recall = F.col("tp") / F.col("size")
    precision = F.when(F.col("guesses") > 0, F.col("tp") / F.col("guesses")).otherwise(0.0)
    both = precision + recall
    f1 = F.when(both > 0, F.lit(2.0) * precision * recall / both).otherwise(0.0)
    fpr = F.coalesce(F.try_divide(F.col("guesses") - F.col("tp"), F.col("total") - F.col("size")),
                     F.lit(0.0))
    share = F.col("size") / F.col("total")
    measured = classes.agg(
        F.sum(F.col("tp") / F.col("total")).alias("accuracy"),
        F.sum(share * fpr).alias("weightedFalsePositiveRate"),
        F.sum(share * recall).alias("weightedTruePositiveRate"),
        F.sum(share * f1).alias("weightedFMeasure"),
        F.sum(share * precision).alias("weightedPrecision"),
        F.sum(share * recall).alias("weightedRecall"))
    drawn = F.lit(None).cast("struct<data:array<array<double>>,classNames:array<string>>")
    if matrix:
        # A row of the matrix only looks through its own cells.
        inside = cells.join(actual.select(F.col("label").alias("prediction")), "prediction", "semi")
        lines = actual.select("label").join(
            inside.groupBy("label").agg(F.map_from_entries(F.collect_list(
                F.struct("prediction", n.cast("double")))).alias("cells")), "label", "left")
        table = lines.agg(F.sort_array(F.collect_list(F.struct("label", F.map_entries(F.coalesce(
            "cells", F.map_from_entries(F.array().cast("array<struct<a:double,b:double>>"))))
            .alias("cells")))).alias("lines"))
        measured = measured.withColumn("lines", table.scalar())
        labels = F.col("lines.label")
        dense = F.transform("lines", lambda line: F.transform(labels, lambda b: F.coalesce(
            F.try_element_at(F.map_from_entries(line["cells"]), b), F.lit(0.0))))
        drawn = F.struct(dense.alias("data"), labels.cast("array<string>").alias("classNames"))
    return measured.select(*MULTICLASS_METRICS, _result(
        MULTICLASS_METRICS, confusionMatrix=drawn, charts=_no_charts()).alias("evaluate_result"))


def evaluate(df: DataFrame, kind: str, prediction: str, label: str, **options) -> DataFrame:
    """The report of the given kind: regression, binary (needs ``bins``) or
    multiclass (needs ``matrix``)."""
    reports = {"regression": eval_regression, "binary": eval_binary,
               "multiclass": eval_multiclass}
    require(kind in reports, f"unknown kind of evaluation: {kind}")
    return reports[kind](df, prediction, label, **options)
