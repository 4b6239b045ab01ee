"""Free SQL: statements over frames and expressions as new columns."""

from pyspark.sql import functions as F

from millrace.operators.columns import with_expr
from millrace.operators.relational import sql_query
from millrace.plans.registry import query, table


def _sql(spark, folder, statement, *tables):
    return sql_query(statement, *[table(spark, folder, t) for t in tables])


@query("sql_query", """
select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as total
from customer join orders on c_custkey = o_custkey group by c_mktsegment""")
def sql_query_two(spark, folder):
    return _sql(spark, folder, """
        select c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as total
        from {0} join {1} on c_custkey = o_custkey group by c_mktsegment""", "customer", "orders")


@query("sql_window_rank", """
select * from (
  select o_custkey, o_orderkey, o_totalprice,
    cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as place
  from orders) where place <= 3""")
def sql_window_rank(spark, folder):
    # The rank limit is applied before the shuffle as well, so no key is ever large.
    return _sql(spark, folder, """
        select * from (
          select o_custkey, o_orderkey, o_totalprice,
            rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place
          from {0}) where place <= 3""", "orders")


@query("sql_window_frame", """
select o_orderpriority, day::varchar as day, total,
  round(sum(total) over w, 2) as running,
  round(avg(total) over (partition by o_orderpriority order by day
                         rows between 6 preceding and current row), 4) as weekly
from (select o_orderpriority, cast(o_orderdate as date) as day,
        round(sum(o_totalprice), 2) as total from orders group by 1, 2)
window w as (partition by o_orderpriority order by day
             rows between unbounded preceding and current row)""")
def sql_window_frame(spark, folder):
    # Reduced to one row per priority and day first: a window holds days, not orders.
    return _sql(spark, folder, """
        select o_orderpriority, cast(day as string) as day, total,
          round(sum(total) over w, 2) as running,
          round(avg(total) over (partition by o_orderpriority order by day
                                 rows between 6 preceding and current row), 4) as weekly
        from (select o_orderpriority, cast(o_orderdate as date) as day,
                round(sum(o_totalprice), 2) as total from {0} group by 1, 2)
        window w as (partition by o_orderpriority order by day
                     rows between unbounded preceding and current row)""", "orders")


@query("sql_rollup", """
select l_returnflag, l_linestatus, cast(grouping(l_returnflag, l_linestatus) as int) as level,
  count(*) as n, sum(l_quantity) as quantity
from lineitem group by rollup (l_returnflag, l_linestatus)""")
def sql_rollup(spark, folder):
    return _sql(spark, folder, """
        select l_returnflag, l_linestatus, cast(grouping_id(l_returnflag, l_linestatus) as int)
          as level, count(*) as n, sum(l_quantity) as quantity
        from {0} group by rollup (l_returnflag, l_linestatus)""", "lineitem")


@query("sql_cube", """
select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top
from orders group by cube (o_orderstatus, o_orderpriority)""")
def sql_cube(spark, folder):
    return _sql(spark, folder, """
        select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top
        from {0} group by cube (o_orderstatus, o_orderpriority)""", "orders")


@query("sql_intersect", """
select o_custkey as k from orders where o_orderstatus = 'F'
intersect select o_custkey from orders where o_orderpriority = '1-URGENT'""")
def sql_intersect(spark, folder):
    return _sql(spark, folder, """
        select o_custkey as k from {0} where o_orderstatus = 'F'
        intersect select o_custkey from {0} where o_orderpriority = '1-URGENT'""", "orders")


@query("sql_except", """
select c_custkey as k from customer
except select o_custkey from orders where o_orderpriority = '1-URGENT'""")
def sql_except(spark, folder):
    return _sql(spark, folder, """
        select c_custkey as k from {0}
        except select o_custkey from {1} where o_orderpriority = '1-URGENT'""",
                "customer", "orders")


@query("sql_cte_subquery", """
with spent as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey)
select c_custkey, c_nationkey, round(total, 2) as total from customer
join spent on o_custkey = c_custkey
where total > (select avg(total) from spent)
  and exists (select 1 from orders x where x.o_custkey = c_custkey and x.o_orderstatus = 'F')""")
def sql_cte_subquery(spark, folder):
    return _sql(spark, folder, """
        with spent as (select o_custkey, sum(o_totalprice) as total from {1} group by o_custkey)
        select c_custkey, c_nationkey, round(total, 2) as total from {0}
        join spent on o_custkey = c_custkey
        where total > (select avg(total) from spent)
          and exists (select 1 from {1} x where x.o_custkey = c_custkey
                      and x.o_orderstatus = 'F')""", "customer", "orders")


@query("sql_range_join", """
select o_orderpriority, count(*) as n_late, sum(l_quantity) as quantity
from orders join lineitem on l_orderkey = o_orderkey
  and l_shipdate > o_orderdate + interval 90 days
group by o_orderpriority""")
def sql_range_join(spark, folder):
    return _sql(spark, folder, """
        select o_orderpriority, count(*) as n_late, sum(l_quantity) as quantity
        from {0} join {1} on l_orderkey = o_orderkey
          and l_shipdate > o_orderdate + interval 90 days
        group by o_orderpriority""", "orders", "lineitem")


@query("expr_string", """
select c_custkey, upper(substr(c_name, 1, 4)) || '/' || lpad(cast(c_nationkey as varchar), 3, '0')
  as tag, length(c_mktsegment)::int as width, instr(c_mktsegment, 'I')::int as place
from customer""")
def expr_string(spark, folder):
    customers = table(spark, folder, "customer")
    for name, expression in [
            ("tag", "concat(upper(substr(c_name, 1, 4)), '/', "
                    "lpad(cast(c_nationkey as string), 3, '0'))"),
            ("width", "length(c_mktsegment)"), ("place", "instr(c_mktsegment, 'I')")]:
        customers = with_expr(customers, name, expression)
    return customers.select("c_custkey", "tag", "width", "place")


@query("expr_date", """
select o_orderkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as m,
  date_diff('day', date '1995-01-01', cast(o_orderdate as date))::int as days
from orders""")
def expr_date(spark, folder):
    orders = table(spark, folder, "orders")
    for name, expression in [
            ("y", "year(o_orderdate)"), ("q", "quarter(o_orderdate)"),
            ("m", "date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd')"),
            ("days", "datediff(cast(o_orderdate as date), date '1995-01-01')")]:
        orders = with_expr(orders, name, expression)
    return orders.select("o_orderkey", "y", "q", "m", "days")


@query("expr_math", """
select l_orderkey, l_linenumber, l_partkey, round(cos(l_quantity) + sin(l_discount), 9) as wave,
  round(ln(l_extendedprice), 9) as magnitude, cast(floor(l_extendedprice / 1000) as bigint) as band
from lineitem""")
def expr_math(spark, folder):
    lines = table(spark, folder, "lineitem")
    for name, expression in [
            ("wave", "round(cos(l_quantity) + sin(l_discount), 9)"),
            ("magnitude", "round(ln(l_extendedprice), 9)"),
            ("band", "floor(l_extendedprice / 1000)")]:
        lines = with_expr(lines, name, expression)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "wave", "magnitude", "band")


@query("expr_array", """
select vec_id, len(list_filter(embedding, lambda x: x > 0))::int as positive,
  round(list_max(embedding)::double, 6) as top,
  round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as power
from embeddings""")
def expr_array(spark, folder):
    vectors = table(spark, folder, "embeddings")
    for name, expression in [
            ("positive", "size(filter(embedding, x -> x > 0))"),
            ("top", "round(cast(array_max(embedding) as double), 6)"),
            ("power", "round(aggregate(transform(embedding, x -> cast(x as double) * "
                      "cast(x as double)), 0D, (s, x) -> s + x), 6)")]:
        vectors = with_expr(vectors, name, expression)
    return vectors.select("vec_id", "positive", "top", "power")


@query("expr_map", """
select event_type, max(cast(json_extract_string(props, '$.k') as int)) as top_k, count(*) as n
from events group by event_type""")
def expr_map(spark, folder):
    events = with_expr(table(spark, folder, "events"), "entries",
                       "from_json(props, 'map<string,int>')")
    return events.groupBy("event_type").agg(F.max(F.col("entries")["k"]).alias("top_k"),
                                            F.count(F.lit(1)).alias("n"))


@query("expr_json", """
select event_id, cast(json_extract_string(props, '$.k') as int) as k from events""")
def expr_json(spark, folder):
    events = with_expr(table(spark, folder, "events"), "k",
                       "cast(get_json_object(props, '$.k') as int)")
    return events.select("event_id", "k")
