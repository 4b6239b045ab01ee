"""Vector and similarity functions."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.functions.sqlfunctions import register_sql_functions
from millrace.functions.vectors import SIMILARITY_CUTS
from millrace.operators.relational import join
from millrace.plans.registry import query, table

NEIGHBOURS = """
select a.vec_id, a.embedding as u, b.embedding as v, a.label
from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1"""


def _neighbours(spark, folder):
    """Each vector with the next one; the last has none."""
    left = table(spark, folder, "embeddings").withColumn("next", F.col("vec_id") + 1)
    return join(left, table(spark, folder, "embeddings"), [("next", "next_id")], "left",
                [("vec_id", "vec_id"), ("label", "label"), ("embedding", "u"), ("next", "next")],
                [("vec_id", "next_id"), ("embedding", "v")])


@query("vector_dot", f"""
select vec_id, round(case when v is null then -1.0
  else list_sum(list_transform(list_zip(u, v), lambda p: p[1]::double * p[2]::double)) end, 6)
  as similarity
from ({NEIGHBOURS})""")
def vector_dot(spark, folder):
    pairs = _neighbours(spark, folder)
    return pairs.select("vec_id", F.round(vectors.dot("u", "v", null_value=-1.0), 6)
                        .alias("similarity"))


@query("vector_sum_normalize", """
with s as (select label, slot, sum(x) as x
  from (select label, unnest(embedding)::double as x,
          unnest(generate_series(0, len(embedding) - 1))::int as slot from embeddings)
  group by 1, 2),
n as (select label, sqrt(sum(x * x)) as length from s group by label)
select label, slot, round(x / length, 6) as x from s join n using (label)""")
def vector_sum_normalize(spark, folder):
    keyed = table(spark, folder, "embeddings").select(
        "label",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("embedding"))
    sums = vectors.normalized_sums(keyed, "label", "embedding", "direction")
    return sums.select("label", F.posexplode("direction").alias("slot", "x")).withColumn(
        "x", F.round("x", 6))


@query("vector_pair_normalize", f"""
with t as (select vec_id, list_transform(list_zip(u, v), lambda p: p[1]::double + p[2]::double) as w
  from ({NEIGHBOURS}) where v is not null)
select vec_id, round(w[1] / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) as first,
  round(w[64] / sqrt(list_sum(list_transform(w, lambda x: x * x))), 6) as last from t""")
def vector_pair_normalize(spark, folder):
    pairs = _neighbours(spark, folder).where("v is not null")
    summed = pairs.select("vec_id", vectors.sum_normalize(F.array("u", "v")).alias("w"))
    return summed.select("vec_id", F.round(F.get("w", F.lit(0)), 6).alias("first"),
                         F.round(F.get("w", F.lit(63)), 6).alias("last"))


# The text form of a vector, and one that is cut short for some rows.
TEXTS = f"""
select vec_id, array_to_string(list_transform(u, lambda x: round(x::double, 5)::varchar), ',') as s,
  array_to_string(list_transform(case when label = 3 then v[1:60] else v end,
    lambda x: round(x::double, 5)::varchar), ',') as t
from ({NEIGHBOURS})"""


def _texts(spark, folder):
    pairs = _neighbours(spark, folder)
    short = F.when(F.col("label") == 3, F.slice("v", 1, 60)).otherwise(F.col("v"))

    def text(column):
        return F.array_join(F.transform(column, lambda x: F.round(x.cast("double"), 5)
                                        .cast("string")), ",")
    return pairs.select("vec_id", text(F.col("u")).alias("s"), text(short).alias("t"))


DOT = """
select vec_id, case when t is null then null when len(a) <> len(b) then -1.0
  else list_sum(list_transform(list_zip(a, b), lambda p: p[1]::double * p[2]::double)) end as d
from (select vec_id, t, string_split(s, ',') as a, string_split(t, ',') as b from ({texts}))
""".format(texts=TEXTS)


@query("csv_vector_dot", f"select vec_id, round(d, 6) as similarity from ({DOT})")
def csv_vector_dot(spark, folder):
    return _texts(spark, folder).select(
        "vec_id", F.round(vectors.csv_dot("s", "t"), 6).alias("similarity"))


@query("piecewise_similar", f"""
select vec_id, case when d is not null then 1 + len(list_filter({SIMILARITY_CUTS}::double[],
  lambda c: c <= d)) end as bucket from ({DOT})""")
def piecewise_similar(spark, folder):
    return _texts(spark, folder).select("vec_id",
                                        vectors.similarity_bucket("s", "t").alias("bucket"))


@query("sql_dot", f"""
select vec_id, round(list_sum(list_transform(list_zip(u, v),
  lambda p: p[1]::double * p[2]::double)), 6) as similarity
from ({NEIGHBOURS}) where v is not null""")
def sql_dot(spark, folder):
    register_sql_functions(spark)
    pairs = _neighbours(spark, folder).where("v is not null")
    vectors_of = pairs.select("vec_id", *[
        array_to_vector(F.col(c).cast("array<double>")).alias(c) for c in ("u", "v")])
    return vectors_of.select("vec_id", F.expr("round(dot(u, v), 6)").alias("similarity"))


@query("sql_similarity", f"""
select vec_id, round(d, 6) as similarity, case when d is not null then 1 + len(list_filter(
  {SIMILARITY_CUTS}::double[], lambda c: c <= d)) end as bucket from ({DOT})""")
def sql_similarity(spark, folder):
    register_sql_functions(spark)
    return _texts(spark, folder).selectExpr("vec_id", "round(csv_dot(s, t), 6) as similarity",
                                            "similarity_bucket(s, t) as bucket")
