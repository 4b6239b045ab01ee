"""Missing values. The tables hold none, so both engines make some."""

from pyspark.sql import functions as F

from millrace.ml.persist import load_fitted, save_fitted
from millrace.operators import missing
from millrace.plans.registry import query, table
from millrace.util import scratch

# Row keys, then columns with holes: numbers with NULL and NaN, text with NULL.
HOLES = """
select l_orderkey, l_partkey, l_suppkey,
  nullif(l_linenumber, 1) as number,
  case when l_linenumber = 2 then 'NaN'::double when l_linenumber = 3 then null
       else l_quantity end as quantity,
  nullif(l_returnflag, 'N') as flag
from lineitem"""


def _holes(spark, folder):
    number = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.nullif(number, F.lit(1)).alias("number"),
        F.when(number == 2, F.lit(float("nan"))).when(number == 3, F.lit(None))
        .otherwise(F.col("l_quantity")).alias("quantity"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"))


FILLED = f"""
select l_orderkey, l_partkey, l_suppkey, coalesce(number, -1) as number,
  case when quantity is null or isnan(quantity) then 0.5 else quantity end as quantity,
  coalesce(flag, 'none') as flag
from ({HOLES})"""
FILL = {"number": "-1", "quantity": "0.5", "flag": "none", "no_such_column": "x"}


@query("fillna", FILLED)
def fillna(spark, folder):
    return missing.fillna(_holes(spark, folder), FILL)


@query("fillna_stage", FILLED)
def fillna_stage(spark, folder):
    path = scratch(spark, "stage")
    save_fitted(missing.FillNa(values=FILL), path)
    return load_fitted(path).transform(_holes(spark, folder))


MISSING_COUNT = ("((number is null)::int + (quantity is null or isnan(quantity))::int "
                 "+ (flag is null)::int)")


def _kept(condition: str) -> str:
    return f"""
select l_orderkey, l_partkey, l_suppkey, number, quantity, flag from ({HOLES})
where {MISSING_COUNT} {condition}"""


COLUMNS = ["number", "quantity", "flag"]


@query("dropna_any", _kept("= 0"))
def dropna_any(spark, folder):
    return missing.dropna(_holes(spark, folder), COLUMNS, "any")


@query("dropna_all", _kept("< 3"))
def dropna_all(spark, folder):
    return missing.dropna(_holes(spark, folder), COLUMNS, "all")


@query("dropna_n", _kept("< 2"))
def dropna_n(spark, folder):
    return missing.dropna(_holes(spark, folder), COLUMNS, 2)


@query("imputer_mean", f"""
with h as ({HOLES}), m as (
  select avg(number) as a, avg(quantity) filter (not isnan(quantity)) as q from h)
select l_orderkey, l_partkey, l_suppkey, round(coalesce(number::double, a), 6) as "number_I",
  round(case when quantity is null or isnan(quantity) then q else quantity end, 6)
    as "quantity_I"
from h, m""")
def imputer_mean(spark, folder):
    filled = missing.impute(_holes(spark, folder), ["number", "quantity"])
    return filled.select("l_orderkey", "l_partkey", "l_suppkey",
                         F.round("number_I", 6).alias("number_I"),
                         F.round("quantity_I", 6).alias("quantity_I"))


@query("imputer_median", f"""
with h as ({HOLES}), m as (
  select quantile_disc(quantity, 0.5) filter (not isnan(quantity)) as q from h)
select l_orderkey, l_partkey, l_suppkey,
  case when quantity is null or isnan(quantity) then q else quantity end as "quantity_I"
from h, m""")
def imputer_median(spark, folder):
    filled = missing.impute(_holes(spark, folder), ["quantity"], "median")
    return filled.select("l_orderkey", "l_partkey", "l_suppkey", "quantity_I")
