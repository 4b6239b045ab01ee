"""Evaluation of predictions that need no model: known labels, scores from the text length."""

from pyspark.sql import functions as F

from millrace.operators import evaluate as ev
from millrace.operators.relational import join
from millrace.plans.registry import query, table

SCORED = """
select quality as y, (n_chars % 97) / 97.0 + quality * 0.2 as score
from labels join documents using (doc_id)"""


def _scored(spark, folder):
    both = join(table(spark, folder, "labels"), table(spark, folder, "documents"),
                [("doc_id", "id")], left_cols=[("doc_id", "doc_id"), ("quality", "y")],
                right_cols=[("doc_id", "id"), ("n_chars", "n_chars")])
    return both.select("y", ((F.col("n_chars") % 97) / F.lit(97.0) + F.col("y") * 0.2)
                       .alias("score"))


# Scores are merged before they are ordered, as equal scores share a threshold.
COUNTS = f"""
with g as (select score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg
           from ({SCORED}) group by score),
c as (select score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp,
        sum(pos) over () as all_pos, sum(neg) over () as all_neg from g
      window w as (order by score desc rows unbounded preceding))"""


@query("eval_binary", f"""{COUNTS},
a as (select *, coalesce((tp - pos) / nullif(tp + fp - pos - neg, 0), tp / (tp + fp)) as before
      from c)
select round(sum(pos / all_pos * (tp / (tp + fp) + before) / 2), 9) as "areaUnderPR",
  round(sum(neg / all_neg * (2 * tp - pos) / (2 * all_pos)), 9) as "areaUnderROC" from a""")
def eval_binary(spark, folder):
    result = ev.eval_binary(_scored(spark, folder), "score", "y", bins=20)
    return result.select(*[F.round(m, 9).alias(m) for m in ev.BINARY_METRICS])


@query("eval_binary_report", f"""{COUNTS}
select 2 as n_metrics, 5 as n_charts, true as thinned from c limit 1""")
def eval_binary_report(spark, folder):
    result = ev.eval_binary(_scored(spark, folder), "score", "y", bins=20)
    shape = ("metrics array<struct<name:string,value:double>>, "
             "charts array<struct<title:string,data:array<struct<x:array<double>>>>>")
    read = result.select(F.from_json("evaluate_result", shape).alias("r"))
    points = F.transform("r.charts", lambda c: F.size(F.get(c["data"], F.lit(0))["x"]))
    return read.select(F.size("r.metrics").alias("n_metrics"), F.size("r.charts").alias("n_charts"),
                       F.array_max(points).between(15, 25).alias("thinned"))


@query("eval_roc_curve", f"""{COUNTS}
select round(score, 9) as threshold, round(fp / all_neg, 9) as fpr, round(tp / all_pos, 9) as tpr
from c union all select null, 0, 0 union all select null, 1, 1""")
def eval_roc_curve(spark, folder):
    return _rounded(ev.roc_curve(_scored(spark, folder), "score", "y"))


@query("eval_pr_curve", f"""{COUNTS}
select round(score, 9) as threshold, round(tp / all_pos, 9) as recall,
  round(tp / (tp + fp), 9) as precision from c
union all (select null, 0, round(tp / (tp + fp), 9) from c order by score desc limit 1)""")
def eval_pr_curve(spark, folder):
    return _rounded(ev.pr_curve(_scored(spark, folder), "score", "y"))


@query("eval_threshold_curve", f"""{COUNTS}
select round(score, 9) as threshold, round(tp / (tp + fp), 9) as precision,
  round(tp / all_pos, 9) as recall, round(2 * tp / (tp + fp + all_pos), 9) as f1 from c""")
def eval_threshold_curve(spark, folder):
    return _rounded(ev.threshold_curve(_scored(spark, folder), "score", "y"))


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("eval_regression", """
with p as (select l_extendedprice as y, l_quantity * 1000 + l_discount as p from lineitem),
m as (select avg(y) as my from p)
select round(avg((p - my) * (p - my)) / 1e6, 6) as "explainedVariance",
  round(avg(abs(y - p)), 6) as "meanAbsoluteError",
  round(avg((y - p) * (y - p)) / 1e6, 6) as "meanSquaredError",
  round(sqrt(avg((y - p) * (y - p))), 6) as "rootMeanSquaredError",
  round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 9) as r2
from p, m""")
def eval_regression(spark, folder):
    scored = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1000 + F.col("l_discount")).alias("p"))
    result = ev.eval_regression(scored, "p", "y")
    return result.select(
        F.round(F.col("explainedVariance") / 1e6, 6).alias("explainedVariance"),
        F.round("meanAbsoluteError", 6).alias("meanAbsoluteError"),
        F.round(F.col("meanSquaredError") / 1e6, 6).alias("meanSquaredError"),
        F.round("rootMeanSquaredError", 6).alias("rootMeanSquaredError"),
        F.round("r2", 9).alias("r2"))


# Labels 1, 3 and 7 are not 0 … n-1; prediction 9 is no label at all.
CLASSES = """
select case l_returnflag when 'A' then 1 when 'N' then 3 else 7 end as label,
  case when l_quantity > 45 then 9 when l_linenumber <= 2 then 1 when l_linenumber <= 5 then 3
    else 7 end as prediction from lineitem"""


def _classes(spark, folder):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.when(flag == "A", 1).when(flag == "N", 3).otherwise(7).alias("label"),
        F.when(F.col("l_quantity") > 45, 9).when(line <= 2, 1).when(line <= 5, 3).otherwise(7)
        .alias("prediction"))


@query("confusion_matrix", f"""
select label::double as label, prediction::double as prediction, count(*) as count
from ({CLASSES}) group by all""")
def confusion_matrix(spark, folder):
    return ev.confusion_matrix(_classes(spark, folder), "prediction", "label")


MEASURES = """
with d as ({classes}), n as (select count(*)::double as n from d),
a as (select label, count(*)::double as size, count(*) filter (label = prediction) as tp
      from d group by label),
g as (select prediction as label, count(*) as guesses from d group by 1),
k as (select size / n as share, tp / size as r, coalesce(tp / guesses, 0) as p,
        (guesses - tp) / (n - size) as fpr, tp / n as hit
      from a left join g using (label), n)
select round(sum(hit), 9) as accuracy,
  round(sum(share * fpr), 9) as "weightedFalsePositiveRate",
  round(sum(share * r), 9) as "weightedTruePositiveRate",
  round(sum(share * case when p + r > 0 then 2 * p * r / (p + r) else 0 end), 9)
    as "weightedFMeasure",
  round(sum(share * p), 9) as "weightedPrecision", round(sum(share * r), 9) as "weightedRecall"{more}
from k"""


@query("eval_multiclass", MEASURES.format(classes=CLASSES, more=", '1.0,3.0,7.0' as classes"))
def eval_multiclass(spark, folder):
    result = ev.eval_multiclass(_classes(spark, folder), "prediction", "label", matrix=True)
    shape = "confusionMatrix struct<classNames:array<string>>"
    classes = F.from_json("evaluate_result", shape)["confusionMatrix"]["classNames"]
    return result.select(*[F.round(m, 9).alias(m) for m in ev.MULTICLASS_METRICS],
                         F.array_join(classes, ",").alias("classes"))


@query("eval_multiclass_many", MEASURES.format(
    classes="select o_custkey as label, case when o_orderkey % 3 = 0 then o_custkey + 1 "
            "else o_custkey end as prediction from orders",
    more=", (select count(distinct label) from d) as classes"))
def eval_multiclass_many(spark, folder):
    """A class for every customer: the cells that occur are counted, no square is drawn."""
    buyers = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("label"),
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0))
        .alias("prediction"))
    result = ev.eval_multiclass(buyers, "prediction", "label", matrix=False)
    return result.select(*[F.round(m, 9).alias(m) for m in ev.MULTICLASS_METRICS],
                         buyers.agg(F.count_distinct("label")).scalar().alias("classes"))
