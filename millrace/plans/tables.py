"""Joins, set operations, sampling, reshaping, grouping and sorting."""

from pyspark.sql import functions as F

from millrace.operators import relational as rel
from millrace.operators import reshape, sampling
from millrace.operators.columns import filter_all, with_expr
from millrace.operators.ordering import row_index, zip_columns
from millrace.plans.registry import query, table

# --- Flagship ---------------------------------------------------------------


@query("revenue_by_nation", """
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
  count(*) as n_lines
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
  join nation on n_nationkey = c_nationkey
where l_shipdate >= timestamp '1996-01-01'
group by n_name order by revenue desc, n_name limit 10""")
def revenue_by_nation(spark, folder):
    lines = filter_all(table(spark, folder, "lineitem"),
                       "l_shipdate >= timestamp_ntz '1996-01-01'")
    sold = rel.join(
        lines.withColumn("sale", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        table(spark, folder, "orders"), [("l_orderkey", "o_orderkey")],
        left_cols=[("l_orderkey", "l_orderkey"), ("sale", "sale")],
        right_cols=[("o_custkey", "o_custkey"), ("o_orderkey", "o_orderkey")])
    # One row per customer before the customer table is joined: a customer
    # with a third of all orders is merged on the map side.
    per_customer = rel.group_agg(sold, "o_custkey", [("sale", "sum", "sale"), ("*", "count", "n")])
    placed = rel.join(per_customer, table(spark, folder, "customer"),
                      [("o_custkey", "c_custkey")],
                      left_cols=[("o_custkey", "o_custkey"), ("sale", "sale"), ("n", "n")],
                      right_cols=[("c_custkey", "c_custkey"), ("c_nationkey", "c_nationkey")])
    per_nation = rel.group_agg(placed, "c_nationkey", [("sale", "sum", "sale"), ("n", "sum", "n")])
    named = rel.join(per_nation, table(spark, folder, "nation"),
                     [("c_nationkey", "n_nationkey")],
                     right_cols=[("n_nationkey", "n_nationkey"), ("n_name", "n_name")])
    result = named.select("n_name", F.round("sale", 2).alias("revenue"),
                          F.col("n").alias("n_lines"))
    return rel.order_by(result, [("revenue", "desc"), ("n_name", "asc")], limit=10)


# --- Joins ------------------------------------------------------------------

ORDER_COLS = [("o_orderkey", "order_key"), ("o_custkey", "buyer"), ("o_totalprice", "price")]
CUSTOMER_COLS = [("c_custkey", "customer"), ("c_mktsegment", "segment")]
# Large orders meet only customers with a high balance, so both sides have unmatched rows.
ON_CUSTOMER = ["buyer == customer", "large == rich"]


def _orders(spark, folder):
    return with_expr(table(spark, folder, "orders"), "large", "o_totalprice > 450000")


def _customers(spark, folder):
    return with_expr(table(spark, folder, "customer"), "rich", "c_acctbal > 4500")


def _join_sql(kind: str, columns="order_key, buyer, price, customer, segment") -> str:
    return f"""
with l as (select o_orderkey as order_key, o_custkey as buyer, o_totalprice as price,
             o_totalprice > 450000 as large from orders),
  r as (select c_custkey as customer, c_mktsegment as segment, c_acctbal > 4500 as rich
        from customer)
select {columns} from l {kind} join r on buyer = customer and large = rich"""


def _joined(spark, folder, how, **options):
    return rel.join(_orders(spark, folder), _customers(spark, folder), ON_CUSTOMER, how,
                    ORDER_COLS, CUSTOMER_COLS, **options)


@query("join_inner", _join_sql("inner"))
def join_inner(spark, folder):
    return _joined(spark, folder, "inner")


@query("join_left", _join_sql("left"))
def join_left(spark, folder):
    return _joined(spark, folder, "left_outer")


@query("join_right", _join_sql("right"))
def join_right(spark, folder):
    return _joined(spark, folder, "right")


@query("join_full", _join_sql("full"))
def join_full(spark, folder):
    return _joined(spark, folder, "outer")


@query("join_semi", _join_sql("semi", "order_key, buyer, price"))
def join_semi(spark, folder):
    return _joined(spark, folder, "left_semi")


@query("join_anti", _join_sql("anti", "order_key, buyer, price"))
def join_anti(spark, folder):
    return _joined(spark, folder, "leftanti")


@query("join_cross", """
with s as (select c_mktsegment as segment, count(*) as buyers from customer group by 1),
  p as (select o_orderpriority as priority, count(*) as orders from orders group by 1)
select segment, buyers, priority, orders from s cross join p""")
def join_cross(spark, folder):
    # Both sides are reduced to one row per category first.
    buyers = rel.group_agg(table(spark, folder, "customer"), "c_mktsegment", [("*", "count", "n")])
    orders = rel.group_agg(table(spark, folder, "orders"), "o_orderpriority", [("*", "count", "n")])
    return rel.join(buyers, orders, how="cross",
                    left_cols=[("c_mktsegment", "segment"), ("n", "buyers")],
                    right_cols=[("o_orderpriority", "priority"), ("n", "orders")])


@query("join_salted_left", _join_sql("left"))
def join_salted_left(spark, folder):
    return _joined(spark, folder, "left", salts=8)


@query("join_salted_full", _join_sql("full"))
def join_salted_full(spark, folder):
    return _joined(spark, folder, "full", salts=8)


HOT_SQL = """
with l as (select case when {left} then 0 else {left_key} end as a, {left_value} as x from {left_table}),
  r as (select case when {right} then 0 else {right_key} end as b, {right_value} as y
        from {right_table})"""


@query("join_hot_both_sides", HOT_SQL.format(
    left="l_quantity > 45", left_key="l_orderkey", left_value="l_linenumber", left_table="lineitem",
    right="o_custkey % 8 = 0", right_key="o_orderkey", right_value="o_custkey",
    right_table="orders") + """
select a is null as no_line, b is null as no_order, x, count(*) as n,
  sum(y)::bigint as buyers from l full join r on a = b group by all""")
def join_hot_both_sides(spark, folder):
    """One key fills a tenth of the lines and an eighth of the orders.

    Its pairs are the product of both, so rows that count alike are counted before they meet: a
    pair of groups stands for all its pairs of rows, and a group without a partner for its rows.
    """
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_quantity") > 45, 0).otherwise(F.col("l_orderkey")).alias("a"),
        F.col("l_linenumber").alias("x"))
    orders = table(spark, folder, "orders").select(
        F.when(F.col("o_custkey") % 8 == 0, 0).otherwise(F.col("o_orderkey")).alias("b"),
        F.col("o_custkey").alias("y"))
    lines = lines.groupBy("a", "x").agg(F.count(F.lit(1)).alias("n_lines"))
    orders = orders.groupBy("b").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("y").alias("ys"))
    joined = rel.join(lines, orders, [("a", "b")], "full", spread_hot=True)
    pairs = F.coalesce("n_lines", F.lit(1)) * F.coalesce("n_orders", F.lit(1))
    return joined.groupBy(F.col("a").isNull().alias("no_line"), F.col("b").isNull().alias("no_order"),
                          "x").agg(F.sum(pairs).alias("n"),
                                   F.sum(F.col("ys") * F.coalesce("n_lines", F.lit(1))).alias("buyers"))


@query("join_salted_full_right", HOT_SQL.format(
    left="o_orderkey = 1", left_key="o_orderkey", left_value="o_totalprice", left_table="orders",
    right="l_linenumber % 3 = 0", right_key="l_orderkey + 5", right_value="l_partkey",
    right_table="lineitem") + " select a, x, b, y from l full join r on a = b")
def join_salted_full_right(spark, folder):
    """One key fills about a third of the right table; each side has rows without a partner."""
    orders = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") == 1, 0).otherwise(F.col("o_orderkey")).alias("a"),
        F.col("o_totalprice").alias("x"))
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_orderkey") + 5).alias("b"),
        F.col("l_partkey").alias("y"))
    return rel.join(orders, lines, [("a", "b")], "full", spread_hot=True)


@query("join_salted_hot_key", """
select l_linenumber, priority, count(*) as n, sum(l_quantity) as quantity
from lineitem join (select l_returnflag as flag, min(o_orderpriority) as priority
                    from orders join lineitem on l_orderkey = o_orderkey group by l_returnflag) f
  on l_returnflag = flag
group by l_linenumber, priority""")
def join_salted_hot_key(spark, folder):
    """Three key values over the whole table: every key is hot."""
    lines = table(spark, folder, "lineitem")
    first = rel.group_agg(
        rel.join(lines, table(spark, folder, "orders"), [("l_orderkey", "o_orderkey")],
                 left_cols=[("l_orderkey", "l_orderkey"), ("l_returnflag", "flag")],
                 right_cols=[("o_orderkey", "o_orderkey"), ("o_orderpriority", "priority")]),
        "flag", [("priority", "min", "priority")])
    tagged = rel.join(lines, first, [("l_returnflag", "flag")],
                      left_cols=[(c, c) for c in ("l_returnflag", "l_linenumber", "l_quantity")],
                      salts=16)
    return rel.group_agg(tagged, ["l_linenumber", "priority"],
                         [("*", "count", "n"), ("l_quantity", "sum", "quantity")])


@query("zip_columns", """
with l as (select row_number() over (order by o_totalprice desc, o_orderkey) as i,
             o_orderkey as order_key, o_totalprice as price from orders),
  r as (select row_number() over (order by c_acctbal, c_custkey) as i, c_custkey as customer,
          c_acctbal as balance from customer)
select order_key, price, customer, balance from l full join r using (i)""")
def zip_columns_query(spark, folder):
    return zip_columns(
        table(spark, folder, "orders"), table(spark, folder, "customer"),
        [("o_totalprice", "desc"), "o_orderkey"], ["c_acctbal", "c_custkey"],
        [("o_orderkey", "order_key"), ("o_totalprice", "price")],
        [("c_custkey", "customer"), ("c_acctbal", "balance")])


@query("row_index", """
select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as position
from orders""")
def row_index_query(spark, folder):
    orders = table(spark, folder, "orders").repartition(5).select("o_orderkey", "o_orderdate")
    return row_index(orders, [("o_orderdate", "desc"), "o_orderkey"], "position").select(
        "o_orderkey", "position")


# --- Set operations ---------------------------------------------------------

@query("union_rows", """
select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def union_rows(spark, folder):
    return rel.union_rows(
        table(spark, folder, "supplier"), table(spark, folder, "customer"),
        [("s_suppkey", "id"), ("s_name", "name"), ("s_acctbal", "balance")],
        [("c_custkey", "id"), ("c_name", "name"), ("c_acctbal", "balance"),
         ("c_mktsegment", "segment")])


@query("distinct_keys", """
select o_custkey, o_orderpriority, o_orderkey, o_totalprice from orders
qualify row_number() over (partition by o_custkey, o_orderpriority
                           order by o_totalprice desc, o_orderkey) = 1""")
def distinct_keys(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey",
                                                   "o_totalprice")
    return rel.distinct(orders, ["o_custkey", "o_orderpriority"],
                        [("o_totalprice", "desc"), ("o_orderkey", "asc")])


@query("distinct_any", """
select count(*) as n, count(distinct (o_custkey, o_orderstatus)) as n_keys, 0 as n_foreign
from (select distinct o_custkey, o_orderstatus from orders)""")
def distinct_any(spark, folder):
    orders = table(spark, folder, "orders")
    kept = rel.distinct(orders, ["o_custkey", "o_orderstatus"])
    # Each kept row must be a whole row of the input.
    known = orders.select(*[F.col(c).alias(f"x_{c}")
                            for c in ("o_orderkey", "o_custkey", "o_totalprice")])
    checked = kept.join(known, F.col("o_orderkey") == F.col("x_o_orderkey"), "left")
    foreign = ~((F.col("o_custkey") == F.col("x_o_custkey"))
                & (F.col("o_totalprice") == F.col("x_o_totalprice")))
    return checked.agg(F.count(F.lit(1)).alias("n"),
                       F.count_distinct("o_custkey", "o_orderstatus").alias("n_keys"),
                       F.count_if(F.coalesce(foreign, F.lit(True))).cast("int")
                       .alias("n_foreign"))


# --- Sampling ---------------------------------------------------------------

@query("sample", """
select true as in_band, 0::bigint as n_foreign, true as unique_rows""")
def sample(spark, folder):
    orders = table(spark, folder, "orders").repartition(6, "o_orderkey")
    part = sampling.sample(orders, 0.25, seed=11).select("o_orderkey", "o_custkey")
    known = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    seen = part.join(known, (F.col("o_orderkey") == F.col("k"))
                     & (F.col("o_custkey") == F.col("c")), "left")
    facts = seen.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"),
                     F.count_if(F.col("k").isNull()).alias("n_foreign"))
    share = F.col("n") / orders.agg(F.count(F.lit(1))).scalar()
    return facts.select(
        share.between(0.22, 0.28).alias("in_band"), "n_foreign",
        (F.col("n") == F.col("d")).alias("unique_rows"))


@query("sample_with_replacement_keyed", """
select true as mean_in_band, true as none_in_band, true as two_in_band, 0::bigint as n_foreign,
  0::bigint as n_moved""")
def sample_with_replacement_keyed(spark, folder):
    """Copies follow the distribution, and are the same ones however the table is partitioned."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")

    def drawn(frame, name):
        part = sampling.sample(frame, 1.5, seed=4, with_replacement=True, key="o_orderkey")
        return part.groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias(name))
    keys = ["o_orderkey", "o_custkey"]
    both = drawn(orders, "n").join(drawn(orders.repartition(7, "o_custkey"), "m"), keys, "full")
    seen = orders.withColumn("known", F.lit(True)).join(both, keys, "full")
    n = F.coalesce("n", F.lit(0))
    # A Poisson number with mean 1.5 is 0 in 22.3 % and 2 in 25.1 % of all cases.
    return seen.agg(
        F.avg(n).between(1.4, 1.6).alias("mean_in_band"),
        F.avg((n == 0).cast("int")).between(0.2, 0.25).alias("none_in_band"),
        F.avg((n == 2).cast("int")).between(0.225, 0.275).alias("two_in_band"),
        F.count_if(F.col("known").isNull()).alias("n_foreign"),
        F.count_if(n != F.coalesce("m", F.lit(0))).alias("n_moved"))


@query("sample_by", """
select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'""")
def sample_by(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.sample_by(orders, "o_orderstatus", {"F": 1.0, "O": 0.0}, seed=3)


@query("sample_by_band", """
select o_orderpriority, true as in_band from orders
where o_orderpriority in ('1-URGENT', '5-LOW') group by 1""")
def sample_by_band(spark, folder):
    orders = table(spark, folder, "orders")
    part = sampling.sample_by(orders, "o_orderpriority", {"1-URGENT": 0.5, "5-LOW": 0.2}, seed=5,
                              key="o_orderkey")
    sizes = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"))
    taken = part.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("total")
    low = F.when(F.col("o_orderpriority") == "5-LOW", 0.2).otherwise(0.5)
    return taken.join(sizes, "o_orderpriority").select(
        "o_orderpriority", share.between(low - 0.05, low + 0.05).alias("in_band"))


def _split_facts(orders, parts):
    tagged = parts[0].select("o_orderkey", F.lit(0).alias("part"))
    for i, part in enumerate(parts[1:], start=1):
        tagged = tagged.union(part.select("o_orderkey", F.lit(i).alias("part")))
    per_key = tagged.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))
    checked = orders.select("o_orderkey").join(per_key, "o_orderkey", "full")
    return checked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("times", F.lit(0)) != 1).alias("n_not_once"))


@query("random_split", "select count(*) as n, 0::bigint as n_not_once from orders")
def random_split(spark, folder):
    # Whole partitions are sorted: their number follows the session, so that a larger table has more.
    tasks = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = table(spark, folder, "orders").repartition(tasks, "o_orderkey")
    return _split_facts(orders, sampling.random_split(orders, 0.7, seed=17))


@query("random_split_keyed", "select count(*) as n, 0::bigint as n_not_once from orders")
def random_split_keyed(spark, folder):
    orders = table(spark, folder, "orders")
    return _split_facts(orders, sampling.random_split(orders, [5, 3, 2], seed=17,
                                                      key="o_orderkey"))


@query("sample_then_split", """
select true as sample_in_band, true as first_in_band, 0::bigint as n_not_once""")
def sample_then_split(spark, folder):
    """Two keyed draws with one seed: the second splits what the first kept by its own shares."""
    orders = table(spark, folder, "orders")
    kept = sampling.sample(orders, 0.25, seed=7, key="o_orderkey")
    first, second = sampling.random_split(kept, 0.7, seed=7, key="o_orderkey")
    marked = (kept.select("o_orderkey", F.lit(0).alias("part"))
              .unionByName(first.select("o_orderkey", F.lit(1).alias("part")))
              .unionByName(second.select("o_orderkey", F.lit(2).alias("part"))))
    counts = marked.groupBy("o_orderkey").agg(
        F.count_if(F.col("part") == 1).alias("in_first"),
        F.count_if(F.col("part") > 0).alias("parts"))
    share = F.sum("in_first") / F.count(F.lit(1))
    of_all = F.count(F.lit(1)) / orders.agg(F.count(F.lit(1)).alias("all")).scalar()
    return counts.agg(
        of_all.between(0.2, 0.3).alias("sample_in_band"),
        share.between(0.62, 0.78).alias("first_in_band"),
        F.count_if(F.col("parts") != 1).alias("n_not_once"))


@query("split_by", """
select o_orderkey, o_orderstatus, case o_orderstatus when 'F' then 0 else 1 end as part
from orders where o_orderstatus in ('F', 'P')""")
def split_by(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    first, second = sampling.split_by(orders, "o_orderstatus", ["F", "P"])
    return first.withColumn("part", F.lit(0)).union(second.withColumn("part", F.lit(1)))


# --- Grouping, reshaping, sorting -------------------------------------------

@query("groupby_agg", """
select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as l_quantity_sum,
  round(avg(l_extendedprice), 4) as l_extendedprice_avg, max(l_discount) as l_discount_max,
  round(stddev_samp(l_quantity), 6) as spread,
  count(distinct l_suppkey) as l_suppkey_count_distinct
from lineitem group by l_returnflag, l_linestatus""")
def groupby_agg(spark, folder):
    grouped = rel.group_agg(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], [
        ("*", "count", "n"), ("l_quantity", "sum"), ("l_extendedprice", "avg"),
        ("l_discount", "max"), ("l_quantity", "stddev_samp", "spread"),
        ("l_suppkey", "count_distinct")])
    return grouped.withColumns({"l_extendedprice_avg": F.round("l_extendedprice_avg", 4),
                                "spread": F.round("spread", 6)})


@query("pivot_agg", """
select o_custkey,
  round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as "F",
  round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as "O"
from orders group by o_custkey""")
def pivot_agg(spark, folder):
    wide = rel.pivot_agg(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus",
                         ["F", "O"], "o_totalprice", "sum")
    return wide.select("o_custkey", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("feature_agg", """
with f as (
  select l_linestatus as encode_feature, l_returnflag, l_quantity from lineitem
  union all select l_shipmonth, l_returnflag, l_quantity
  from (select *, strftime(l_shipdate, '%Y-%m') as l_shipmonth from lineitem))
select encode_feature, sum(case when l_returnflag = 'A' then l_quantity end) as "A",
  sum(case when l_returnflag = 'R' then l_quantity end) as "R"
from f group by encode_feature""")
def feature_agg(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return reshape.feature_agg(lines, ["l_linestatus", "l_shipmonth"], "l_returnflag", ["A", "R"],
                               "l_quantity", "sum")


@query("unpivot", """
select l_orderkey, l_linenumber, unnest([l_quantity, l_discount, l_tax]) as measure from lineitem""")
def unpivot(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount",
                                                    "l_linenumber", "l_tax")
    return reshape.unpivot(lines, ["l_quantity", "l_discount", "l_tax"], "measure")


@query("explode", """
select doc_id, unnest(string_split(text, ' ')) as word from documents""")
def explode(spark, folder):
    words = table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("word"))
    return reshape.explode(words, "word")


@query("order_by", """
select o_orderkey, o_orderpriority, o_totalprice from orders
order by o_orderpriority desc, o_totalprice, o_orderkey""")
def order_by(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rel.order_by(orders, [("o_orderpriority", "desc"), ("o_totalprice", "asc"),
                                 ("o_orderkey", "asc")])


@query("top_k", """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 50""")
def top_k(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                    "l_extendedprice")
    return rel.order_by(lines, [("l_extendedprice", "desc"), "l_orderkey", "l_linenumber",
                                "l_partkey"], limit=50)
