"""Column operators."""

from pyspark import StorageLevel
from pyspark.sql import functions as F

from millrace.operators import columns as ops
from millrace.plans.registry import query, table


@query("select_rename", """
select l_orderkey as order_key, l_quantity as quantity, l_returnflag as flag from lineitem""")
def select_rename(spark, folder):
    return ops.select_as(table(spark, folder, "lineitem"), [
        ("l_returnflag", "flag"), ("l_orderkey", "order_key"), ("l_quantity", "quantity"),
        ("no_such_column", "ignored")])


@query("rename", """
select c_custkey as id, c_name as name, c_nationkey, c_acctbal as balance, c_mktsegment
from customer""")
def rename(spark, folder):
    return ops.rename(table(spark, folder, "customer"),
                      {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})


@query("filter_multi", """
select l_orderkey, l_partkey, l_quantity, l_discount from lineitem
where l_quantity > 10 and l_discount between 0.02 and 0.06
  and l_shipdate >= timestamp '1998-01-01' and l_returnflag <> 'N'""")
def filter_multi(spark, folder):
    kept = ops.filter_all(table(spark, folder, "lineitem"), [
        "l_quantity > 10", "l_discount between 0.02D and 0.06D",
        "l_shipdate >= timestamp_ntz '1998-01-01'", "l_returnflag <> 'N'"])
    return kept.select("l_orderkey", "l_partkey", "l_quantity", "l_discount")


@query("cast_types", """
select o_orderkey, cast(o_custkey as varchar) as o_custkey, cast(null as int) as o_orderstatus,
  cast(trunc(o_totalprice) as int) as o_totalprice,
  cast(o_orderdate as date)::varchar as o_orderdate,
  try_cast(substr(o_orderpriority, 1, 1) as bigint) as o_orderpriority
from orders""")
def cast_types(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "o_orderpriority", F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".75")))
    days = ops.cast(orders, [
        ("o_orderdate", "date"), ("o_custkey", "string"), ("o_totalprice", "int"),
        ("o_orderstatus", "int"), ("o_orderpriority", "bigint")])
    return ops.cast(days, {"o_orderdate": "string"})


@query("with_id", """
select count(*) as n, count(*) as n_ids, true as rising from orders""")
def with_id(spark, folder):
    orders = table(spark, folder, "orders").repartition(6, "o_orderkey")
    ids = ops.with_id(orders, "id")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"),
                   (F.min("id") >= 0).alias("rising"))


@query("with_lit", """
select s_suppkey, s_name, 'dc1' as site, cast(7 as int) as batch from supplier""")
def with_lit(spark, folder):
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return ops.with_lit(ops.with_lit(suppliers, "site", "dc1"), "batch", 7)


@query("expr_column", """
select l_orderkey, l_linenumber, l_partkey,
  round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge
from lineitem""")
def expr_column(spark, folder):
    charged = ops.with_expr(table(spark, folder, "lineitem"), "charge",
                            "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)")
    return charged.select("l_orderkey", "l_linenumber", "l_partkey", "charge")


@query("merge_cols", """
select o_orderkey,
  concat_ws('|', nullif(o_orderstatus, 'F'), o_orderpriority, cast(o_custkey as varchar)) as tag
from orders""")
def merge_cols(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        "o_orderpriority", "o_custkey")
    return ops.merge_cols(orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], "tag", "|",
                          keep=False)


@query("split_col", """
select o_orderkey, split_part(o_orderpriority, '-', 1) as o_orderpriority_0,
  split_part(o_orderpriority, '-', 2) as o_orderpriority_1,
  cast(null as varchar) as o_orderpriority_2
from orders""")
def split_col(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return ops.split_col(orders, "o_orderpriority", "-", num=3, keep=False)


@query("split_col_array", """
select doc_id, len(regexp_split_to_array(text, '\\s+'))::int as words,
  regexp_split_to_array(text, '\\s+')[1] as first_word
from documents""")
def split_col_array(spark, folder):
    split = ops.split_col(table(spark, folder, "documents").select("doc_id", "text"), "text",
                          r"\s+")
    return split.select("doc_id", F.size("text_split").alias("words"),
                        F.get("text_split", F.lit(0)).alias("first_word"))


@query("cache", """
select l_returnflag, count(*) as n, max(l_extendedprice) as top from lineitem
group by l_returnflag""")
def cache(spark, folder):
    kept = ops.cache(table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice"),
                     StorageLevel.MEMORY_AND_DISK_DESER)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                            F.max("l_extendedprice").alias("top"))


@query("repartition", """
select l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem
group by l_linestatus""")
def repartition(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_linestatus", "l_quantity")
    spread = ops.repartition(ops.repartition(lines, 12), 5, shuffle=False)
    return spread.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("l_quantity").alias("quantity"))
