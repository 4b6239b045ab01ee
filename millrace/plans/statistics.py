"""Column statistics, profiles and previews."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import profile as prof
from millrace.operators import stats
from millrace.operators import sketches
from millrace.operators.pages import PageDirectory
from millrace.plans.registry import query, table
from millrace.util import written

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, columns, digits):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def _matrix_sql(cell, digits: int) -> str:
    rows = [f"select '{a}' as \"Columns\", " + ", ".join(
        f"round({cell(a, b)}, {digits}) as {b}" for b in NUMBERS) + " from lineitem"
        for a in NUMBERS]
    return "\nunion all ".join(rows)


@query("corr_matrix", _matrix_sql(lambda a, b: "1.0::double" if a == b else f"corr({a}, {b})", 9)
       .replace("from lineitem", "from lineitem group by all"))
def corr_matrix(spark, folder):
    return _rounded(stats.corr_matrix(table(spark, folder, "lineitem"), NUMBERS), NUMBERS, 9)


@query("cov_matrix", _matrix_sql(lambda a, b: f"covar_samp({a}, {b})", 6))
def cov_matrix(spark, folder):
    return _rounded(stats.cov_matrix(table(spark, folder, "lineitem"), NUMBERS), NUMBERS, 6)


SLOTS = 64


@query("corr_matrix_wide", f"""
with d as (select vec_id, unnest(embedding)::double as x, unnest(range({SLOTS}))::int as slot
  from embeddings),
w as (select vec_id, slot, case when (vec_id + slot) % 7 = 0 then null else x end as x from d)
select a.slot as i, b.slot as j,
  case when a.slot = b.slot then 1.0 else round(corr(a.x, b.x), 9) end::double as corr,
  round(covar_samp(a.x, b.x), 9) as cov
from w a join w b on a.vec_id = b.vec_id group by 1, 2""")
def corr_matrix_wide(spark, folder):
    """All pairs of the slots of the vectors, each slot missing in a seventh of the rows."""
    vectors = table(spark, folder, "embeddings")
    wide = vectors.select([
        F.when((F.col("vec_id") + i) % 7 != 0, F.get("embedding", F.lit(i)).cast("double"))
        .alias(f"x{i}") for i in range(SLOTS)])

    def cells(matrix, name):
        return matrix.select(
            F.substring("Columns", 2, 2).cast("int").alias("i"), F.posexplode(F.array(
                *[F.round(f"x{j}", 9) for j in range(SLOTS)])).alias("j", name))
    return cells(stats.corr_matrix(wide, wide.columns), "corr").join(
        cells(stats.cov_matrix(wide, wide.columns), "cov"), ["i", "j"])


@query("describe", """
with d as (select o_totalprice as p, o_orderpriority as t from orders)
select 'count' as summary, count(p)::double as price, count(t)::varchar as priority from d
union all select 'mean', round(avg(p), 4), null from d
union all select 'stddev', round(stddev_samp(p), 4), null from d
union all select 'min', min(p), min(t) from d
union all select 'max', max(p), max(t) from d""")
def describe(spark, folder):
    described = stats.describe(table(spark, folder, "orders"), ["o_totalprice", "o_orderpriority"])
    return described.select("summary", F.round(F.col("o_totalprice").cast("double"), 4)
                            .alias("price"), F.col("o_orderpriority").alias("priority"))


PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@query("quantiles", "\nunion all ".join(
    f"select {p}::double as quantiles, quantile_disc(l_quantity, {p}) as l_quantity, "
    f"quantile_disc(l_extendedprice, {p}) as l_extendedprice, "
    f"quantile_disc(l_linenumber::double, {p}) as l_linenumber from lineitem"
    for p in PROBABILITIES))
def quantiles(spark, folder):
    return stats.quantiles(table(spark, folder, "lineitem"),
                           ["l_quantity", "l_extendedprice", "l_linenumber"], PROBABILITIES)


@query("quantiles_approx", """
select unnest([0.25, 0.5, 0.75])::double as quantiles, true as price_close, true as quantity_close""")
def quantiles_approx(spark, folder):
    """The rank of each sketched value, counted exactly, is within the error."""
    lines = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity")
    columns = {"l_extendedprice": "price_close", "l_quantity": "quantity_close"}
    found = stats.quantiles(lines, list(columns), [0.25, 0.5, 0.75], error=0.01)
    # Two counts per probability, all in one pass.
    wide = found.groupBy().pivot("quantiles", [0.25, 0.5, 0.75]).agg(
        *[F.first(c).alias(c) for c in columns])
    cuts = wide.select(F.struct(*[F.col(f"`{c}`") for c in wide.columns])).scalar()
    joined = lines.withColumn("cuts", cuts)
    checks = []
    for p in (0.25, 0.5, 0.75):
        for c in columns:
            cut = F.col("cuts")[f"{p}_{c}"]
            checks += [F.avg((F.col(c) < cut).cast("int")).alias(f"lt{p}{c}"),
                       F.avg((F.col(c) <= cut).cast("int")).alias(f"le{p}{c}")]
    counted = joined.agg(*checks)
    rows = F.array(*[F.struct(F.lit(p).alias("quantiles"), *[
        ((F.col(f"`lt{p}{c}`") <= p + 0.01) & (F.col(f"`le{p}{c}`") >= p - 0.01)).alias(out)
        for c, out in columns.items()]) for p in (0.25, 0.5, 0.75)])
    return counted.select(F.inline(rows))


@query("freq_items_exact", """
select string_agg(distinct v, ',' order by v) filter (c = 'p') as "priority",
  string_agg(distinct v, ',' order by v) filter (c = 's') as "status"
from (select 'p' as c, o_orderpriority as v from orders group by 2
      having count(*) >= 0.2 * (select count(*) from orders)
      union all select 's', o_orderstatus from orders group by 2
      having count(*) >= 0.3 * (select count(*) from orders))""")
def freq_items_exact(spark, folder):
    orders = table(spark, folder, "orders")
    often = stats.freq_items(orders, ["o_orderpriority"], 0.2, exact=True)
    status = stats.freq_items(orders, ["o_orderstatus"], 0.3, exact=True)
    both = often.withColumn("o_orderstatus_freqItems", status.scalar())

    def text(column):
        joined = F.array_join(column, ",")
        return F.nullif(joined, F.lit(""))
    return both.select(text("o_orderpriority_freqItems").alias("priority"),
                       text("o_orderstatus_freqItems").alias("status"))


@query("freq_items", """
select 'l_linenumber' as "column", l_linenumber::varchar as item, true as found from lineitem
group by 2 having count(*) >= 0.1 * (select count(*) from lineitem)
union all select 'l_quantity', l_quantity::varchar, true from lineitem
group by 2 having count(*) >= 0.015 * (select count(*) from lineitem)""")
def freq_items(spark, folder):
    """Every item that is frequent by exact count is in the sketch."""
    lines = table(spark, folder, "lineitem").select("l_linenumber", "l_quantity")
    parts = []
    for column, support in (("l_linenumber", 0.1), ("l_quantity", 0.015)):
        sketch = stats.freq_items(lines, [column], support)
        exact = stats.freq_items(lines, [column], support, exact=True)
        name = f"{column}_freqItems"
        both = exact.withColumn("found", sketch.scalar())
        parts.append(both.select(F.lit(column).alias("column"), "found",
                                 F.explode(name).alias("item"))
                     .select("column", F.col("item").cast("string").alias("item"),
                             F.array_contains("found", F.col("item")).alias("found")))
    return parts[0].union(parts[1])


PROFILED = """
select case when l_linenumber = 1 then null else l_quantity end as quantity, l_linenumber as number,
  case l_returnflag when 'N' then '' when 'R' then null else l_returnflag || l_linestatus end
    as flag, l_extendedprice as price
from lineitem"""


def _profiled(spark, folder):
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("quantity"),
        F.col("l_linenumber").alias("number"),
        F.when(flag == "N", "").when(flag == "R", F.lit(None))
        .otherwise(F.concat(flag, "l_linestatus")).alias("flag"),
        F.col("l_extendedprice").alias("price"))


PROFILE_COLUMNS = ["quantity", "number", "flag", "price"]


def _numeric_stats(c: str) -> str:
    return (f"select '{c}' as \"column\", 'numeric' as kind, count({c}) as count, "
            f"min({c})::double as min, max({c})::double as max, round(avg({c}), 6) as mean, "
            f"round(stddev_pop({c}), 6) as stddev, round(var_pop({c}), 4) as variance, "
            f"count(distinct {c}) as countdistinct, count(*) - count({c}) as countmissing from p")


@query("profile_stats", f"""
with p as ({PROFILED})
{_numeric_stats('quantity')}
union all {_numeric_stats('number')}
union all {_numeric_stats('price')}
union all select 'flag', 'string', count(*), null, null, null, null, null, count(distinct flag),
  count(*) filter (flag is null or flag = '') from p""")
def profile_stats(spark, folder):
    found = prof.profile_stats(_profiled(spark, folder), PROFILE_COLUMNS, exact=True)
    return found.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6),
                              "variance": F.round("variance", 4)})


@query("profile_histogram", f"""
with p as ({PROFILED}), v as (
  select 'quantity' as "column", quantity as x from p where quantity is not null
  union all select 'price', price from p),
r as (select "column", min(x) as lo, max(x) as hi from v group by 1)
select "column", least(floor((x - lo) / (hi - lo) * 10), 9)::int as position, count(*) as y
from v join r using ("column") group by 1, 2""")
def profile_histogram(spark, folder):
    bars = prof.profile_histogram(_profiled(spark, folder), ["quantity", "price"], exact=True,
                                  numbers="by_count")
    return bars.select("column", "position", "y").where("y > 0")


@query("profile_topn", f"""
with p as ({PROFILED}), v as (
  select 'number' as "column", number::varchar as x from p
  union all select 'flag', flag from p where flag <> '')
select "column", (row_number() over (partition by "column" order by count(*) desc, x) - 1)::int
  as position, x, count(*) as y
from v group by "column", x
qualify row_number() over (partition by "column" order by count(*) desc, x) <= 10""")
def profile_topn(spark, folder):
    return prof.profile_histogram(_profiled(spark, folder), ["number", "flag"], exact=True,
                                  numbers="values")


@query("profile", """
select 'o_totalprice' as "column", 'o_totalprice' as name, 9 as n_stats, count(*)::varchar as n,
  10 as n_bars, count(*) as total from orders
union all select 'o_orderpriority', 'o_orderpriority', 4, count(*)::varchar,
  least(count(distinct o_orderpriority), 10)::int, count(*) from orders""")
def profile(spark, folder):
    report = prof.profile(table(spark, folder, "orders"), ["o_totalprice", "o_orderpriority"],
                          numbers="ranges")
    shape = ("name string, statistics array<struct<name:string,value:string>>, "
             "histogram struct<x:array<string>,y:array<bigint>>")
    read = report.select("column", F.from_json("vis", shape).alias("v"))
    return read.select(
        "column", "v.name", F.size("v.statistics").alias("n_stats"),
        F.get("v.statistics", F.lit(0))["value"].alias("n"),
        F.size("v.histogram.x").alias("n_bars"),
        F.aggregate("v.histogram.y", F.lit(0).cast("bigint"), lambda s, y: s + y).alias("total"))


@query("profile_default", """
select 'o_totalprice' as "column", count(*) as count, 0::bigint as missing, true as distinct_close
from orders
union all select 'o_custkey', count(*), 0, true from orders
union all select 'o_orderpriority', count(*), 0, true from orders""")
def profile_default(spark, folder):
    """Sketched distinct counts lie within four of the sketch's standard errors of 5 %."""
    orders = table(spark, folder, "orders")
    columns = ["o_totalprice", "o_custkey", "o_orderpriority"]
    sketched = prof.profile_stats(orders, columns)
    exact = prof.profile_stats(orders, columns, exact=True).select(
        "column", F.col("countdistinct").alias("n"))
    error = F.abs(F.col("countdistinct") - F.col("n"))
    return sketched.join(exact, "column").select(
        "column", "count", F.col("countmissing").alias("missing"),
        (error <= 0.2 * F.col("n")).alias("distinct_close"))


@query("profile_merged", f"""
with p as ({PROFILED})
{" union all ".join(f"""select '{c}' as "column", count({c}) as count, min({c})::double as min,
  max({c})::double as max, round(avg({c}), 6) as mean, round(var_pop({c}) / 1000, 4) as variance,
  count(*) - count({c}) as countmissing, true as distinct_close, true as median_close,
  true as ranges_close from p""" for c in ("quantity", "number", "price"))}
union all select 'flag', count(*), null, null, null, null,
  count(*) filter (flag is null or flag = ''), true, null, null from p""")
def profile_merged(spark, folder):
    """The states of seven parts are kept, and merged without reading a row again."""
    lines = _profiled(spark, folder)
    parts = written(sketches.profile_state(lines, PROFILE_COLUMNS, by=["number"]), "states")
    whole = written(sketches.merge_states(parts.drop("number")), "states")
    found = sketches.state_stats(whole)
    stats = written(prof.profile_stats(lines, PROFILE_COLUMNS, exact=True), "stats")
    exact = stats.select("column", F.col("countdistinct").alias("n"))
    middles = {c: F.col(c) for c in ("quantity", "number", "price")}
    medians = sketches.state_quantiles(whole, [0.5]).groupBy().pivot("column", list(middles)).agg(
        F.first("value"))
    counted = lines.withColumn("m", medians.select(F.struct(*middles)).scalar()).agg(*[
        F.struct(F.count_if(c < F.col(f"m.{n}")) / F.count(c),
                 F.count_if(c <= F.col(f"m.{n}")) / F.count(c)).alias(n) for n, c in middles.items()])
    medians = counted.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), ((F.col(f"{n}.col1") <= 0.52) & (F.col(f"{n}.col2") >= 0.48))
                 .alias("median_close")) for n in middles])))
    bars = prof.profile_histogram(lines, list(middles), numbers="ranges", stats=stats).select(
        "column", "position", F.col("y").alias("bar"))
    sizes = F.abs(F.col("y") - F.col("bar")) <= 0.03 * F.sum("bar").over(Window.partitionBy("column"))
    bars = (bars.join(sketches.state_ranges(whole), ["column", "position"], "full")
            .withColumn("close", sizes).groupBy("column").agg(F.bool_and(F.coalesce(
                "close", F.lit(False))).alias("ranges_close")))
    return found.join(exact, "column").join(medians, "column", "left").join(bars, "column", "left").select(
        "column", "count", "min", "max", F.round("mean", 6).alias("mean"),
        F.round(F.col("variance") / 1000, 4).alias("variance"), "countmissing",
        (F.abs(F.col("countdistinct") - F.col("n")) <= 0.1 * F.col("n")).alias("distinct_close"),
        "median_close", "ranges_close")


@query("profile_infinite", """
with v as (select case when l_linenumber = 1 then 'Infinity' when l_linenumber = 2 then '-Infinity'
    else (l_linenumber::double)::varchar end as x from lineitem)
select 'x' as "column", (row_number() over (order by count(*) desc, x) - 1)::int as position, x,
  count(*) as y from v group by x""")
def profile_infinite(spark, folder):
    """Infinite values have no ranges, but they are values that can be counted."""
    line = F.col("l_linenumber").cast("double")
    odd = table(spark, folder, "lineitem").select(
        F.when(line == 1, float("inf")).when(line == 2, float("-inf")).otherwise(line).alias("x"))
    return prof.profile_histogram(odd, "x", numbers="values")


@query("preview_page", """
select o_orderkey::varchar as o_orderkey, o_orderstatus, o_totalprice::varchar as o_totalprice
from (select * from orders order by o_totalprice desc, o_orderkey limit 20 offset 20)""")
def preview_page(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return prof.page(orders, [("o_totalprice", "desc"), "o_orderkey"], number=2, rows=20)


@query("preview_page_deep", """
select o_orderkey::varchar as o_orderkey, o_orderstatus from orders
order by o_totalprice desc, o_orderkey limit 20 offset 220""")
def preview_page_deep(spark, folder):
    """A page from the directory of ranges: no task keeps the rows before it."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    pages = PageDirectory(orders, [("o_totalprice", "desc"), "o_orderkey"])
    return pages.page(number=12, rows=20).drop("o_totalprice")


@query("preview_page_last", """
with n as (select count(*) as n, count(*) % 70 as last from lineitem)
select l_orderkey::varchar as l_orderkey, l_extendedprice::varchar as l_extendedprice,
  ceil((select n from n) / 70)::int as pages
from (select *, row_number() over (order by l_extendedprice, l_orderkey, l_partkey, l_suppkey,
        l_linenumber) as r from lineitem), n where r > n - last""")
def preview_page_last(spark, folder):
    """The last page of all lines, with the number of pages."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    pages = PageDirectory(lines, ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey",
                                  "l_linenumber"])
    count = pages.page_count(70)
    return pages.page(count, 70).select("l_orderkey", "l_extendedprice",
                                        F.lit(count).alias("pages"))


@query("preview", """
select c_custkey::varchar as c_custkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), 'null')
  as c_mktsegment from customer order by c_acctbal desc, customer.c_custkey limit 100""")
def preview(spark, folder):
    customers = table(spark, folder, "customer").withColumn(
        "c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    first = prof.preview(customers, 100, [("c_acctbal", "desc"), "c_custkey"])
    return first.select("c_custkey", "c_name", "c_mktsegment")


@query("observe_counts", """
select count(*) as rows, count(*) filter (l_returnflag = 'N') as flag_nulls,
  0::bigint as quantity_nulls, sum(l_quantity) as total from lineitem""")
def observe_counts(spark, folder):
    # A session of its own; see observe_counts.
    lines = table(spark.newSession(), folder, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_quantity").alias("quantity"))
    watched, observation = prof.observe_counts(lines)
    total = watched.agg(F.sum("quantity").alias("total")).first()["total"]
    seen = observation.get
    return spark.createDataFrame(
        [(seen["rows"], seen["flag_nulls"], seen["quantity_nulls"], total)],
        "rows bigint, flag_nulls bigint, quantity_nulls bigint, total double")
