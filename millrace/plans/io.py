"""Sources and sinks: whole tables are written, read back and compared."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from millrace.plans.registry import query, table
from millrace.sources import readers, tfrecord, writers
from millrace.util import scratch, written

ALL_ORDERS = """
select * replace (strftime(o_orderdate, '%Y-%m-%d') as o_orderdate) from orders"""


def _orders(spark, folder):
    return table(spark, folder, "orders")


def _shown(orders):
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("scan_parquet", """
select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem
where l_quantity >= 5 group by l_returnflag""")
def scan_parquet(spark, folder):
    lines = readers.read_parquet(spark, f"{folder}/lineitem.parquet")
    return (lines.where("l_quantity >= 5").groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


@query("scan_parquet_list", """
select r_regionkey as k, r_name as name from region
union all select r_regionkey, r_name from region""")
def scan_parquet_list(spark, folder):
    path = f"{folder}/region.parquet"
    return readers.read_parquet(spark, f"{path}, {path}").select(
        F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))


@query("io_parquet", ALL_ORDERS)
def io_parquet(spark, folder):
    path = scratch(spark, "parquet")
    writers.write_parquet(_orders(spark, folder), path, "overwrite")
    return _shown(readers.read_parquet(spark, path))


@query("io_orc", ALL_ORDERS)
def io_orc(spark, folder):
    path = scratch(spark, "orc")
    writers.write_orc(_orders(spark, folder), path, "error")
    return _shown(readers.read_orc(spark, path))


@query("io_csv", "select * from customer")
def io_csv(spark, folder):
    path = scratch(spark, "csv")
    customers = table(spark, folder, "customer")
    writers.write_csv(customers, path, "overwrite", sep="|")
    return readers.read_csv(spark, path, sep="|", header=False, schema=customers.schema)


@query("io_csv_inferred", """
select s_suppkey::int as s_suppkey, s_name, s_nationkey, s_acctbal from supplier""")
def io_csv_inferred(spark, folder):
    path = scratch(spark, "csv")
    padded = table(spark, folder, "supplier").withColumn(
        "s_name", F.concat(F.lit("  "), "s_name", F.lit(" ")))
    writers.write_csv(padded, path, "overwrite", sep="\t", header=True)
    return readers.read_csv(spark, path, sep="\t", header=True)


@query("io_json", """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props
from events""")
def io_json(spark, folder):
    path = scratch(spark, "json")
    events = table(spark, folder, "events")
    writers.write_json(events, path, "overwrite")
    back = readers.read_json(spark, path, schema=events.schema)
    return back.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("io_text", """
select line as value, count(*) as n
from (select unnest(string_split(text, chr(10))) as line from documents) group by line""")
def io_text(spark, folder):
    path = scratch(spark, "text")
    lines = table(spark, folder, "documents").select(
        F.explode(F.split("text", "\n")).alias("value"))
    writers.write_text(lines, path, "overwrite")
    return readers.read_text(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("io_table", """
select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders
where o_orderstatus = 'F' and o_totalprice > 1000""")
def io_table(spark, folder):
    path = scratch(spark, "table")
    name = "orders_" + path.rsplit("-", 1)[1]
    orders = _orders(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice",
                                           "o_orderstatus")
    writers.write_table(orders, name, "overwrite", partition_by=["o_orderstatus"], path=path)
    found = written(readers.read_table(
        spark, name, "o_orderstatus = 'F' and o_totalprice > 1000"), "read-table")
    spark.sql(f"drop table {name}")
    return found


@query("sql_source", """
select o_orderstatus, count(*) as n, max(o_totalprice) as top from orders group by o_orderstatus""")
def sql_source(spark, folder):
    return readers.read_sql(spark, f"""
        select o_orderstatus, count(*) as n, max(o_totalprice) as top
        from parquet.`{folder}/orders.parquet` group by o_orderstatus""")


@query("io_libsvm", """
select label::double as label, slot::int as slot, round(sum(x::double), 5) as total, count(*) as n
from (select label, unnest(embedding) as x, unnest(generate_series(0, len(embedding) - 1)) as slot
      from embeddings) group by all""")
def io_libsvm(spark, folder):
    path = scratch(spark, "libsvm")
    vectors = table(spark, folder, "embeddings").select(
        F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    vectors.write.format("libsvm").save(path)
    back = readers.read_libsvm(spark, path, num_features=64)
    slots = back.select("label", F.posexplode(vector_to_array("features")).alias("slot", "x"))
    return slots.groupBy("label", "slot").agg(F.round(F.sum("x"), 5).alias("total"),
                                              F.count(F.lit(1)).alias("n"))


@query("io_tfrecord", """
select o_orderkey, round(cast(o_totalprice as float)::double, 2) as price, o_orderstatus,
  nullif(o_orderpriority, '5-LOW') as o_orderpriority, o_custkey - 100 as shifted
from orders""")
def io_tfrecord(spark, folder):
    path = scratch(spark, "tfrecord")
    orders = _orders(spark, folder).select(
        "o_orderkey", F.col("o_totalprice").cast("float").alias("price"), "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.array(F.col("o_custkey") - 100).alias("shifted"))
    tfrecord.write_tfrecord(orders, path, "overwrite")
    back = tfrecord.read_tfrecord(spark, path, orders.schema)
    return back.withColumns({"price": F.round(F.col("price").cast("double"), 2),
                             "shifted": F.get("shifted", F.lit(0))})


@query("io_tfrecord_sequence", """
select doc_id, lang, len(lines)::int as lines,
  list_sum(list_transform(lines, lambda l: len(string_split(l, ' '))))::bigint as words,
  md5(array_to_string(lines, chr(10))) as digest
from (select doc_id, lang, string_split(text, chr(10)) as lines from documents)""")
def io_tfrecord_sequence(spark, folder):
    path = scratch(spark, "tfrecord")
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    documents = table(spark, folder, "documents").select("doc_id", "lang", lines.alias("words"))
    tfrecord.write_tfrecord(documents, path, "overwrite", "SequenceExample")
    back = tfrecord.read_tfrecord(spark, path, record_type="SequenceExample")
    text = F.array_join(F.transform("words", lambda line: F.array_join(line, " ")), "\n")
    return back.select(
        "doc_id", "lang", F.size("words").alias("lines"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.size(w)).alias("words"),
        F.md5(text.cast("binary")).alias("digest"))


# One of twelve folders, by the language and the number of a document.
FOLDERS = """
select *, case lang when 'en' then 10 when 'de' then 20 when 'fr' then 30 else 40 end as a,
  100 + doc_id % 3 as b from documents"""


@query("io_binary_keyed", f"""
select source || '_' || doc_id as key, source as spu_id, doc_id::varchar as goods_no,
  md5(text) as digest, a::varchar as first_category, b::varchar as second_category,
  (a + b)::varchar as third_category
from ({FOLDERS})""")
def io_binary_keyed(spark, folder):
    """Documents in twelve folders of sequence files, written in one pass and read as one."""
    base, tasks = scratch(spark, "keyed"), 4
    lang, languages = F.col("lang"), {"en": 10, "de": 20, "fr": 30}
    first = F.lit(40)
    for name, number in languages.items():
        first = F.when(lang == name, number).otherwise(first)
    places = [(a, 100 + b) for a in (10, 20, 30, 40) for b in range(3)]
    place = (first / 10 - 1) * 3 + F.col("doc_id") % 3
    # Sequence files can only be written pair by pair: rows pass through Python workers here. The
    # part of the output follows from the folder, so that one pass writes all folders.
    part = place * tasks + F.pmod(F.xxhash64("doc_id"), F.lit(tasks))
    keyed = table(spark, folder, "documents").select(
        part.cast("int"), F.struct(F.concat_ws("_", "source", "doc_id"), F.encode("text", "UTF-8")))
    (keyed.rdd.map(tuple).partitionBy(len(places) * tasks, lambda p: p).map(lambda r: tuple(r[1]))
     .saveAsSequenceFile(f"{base}/all"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (a, b) in enumerate(places):
        target = hadoop.Path(f"{base}/{a}/{b}/{a + b}")
        system.mkdirs(target)
        for n in range(i * tasks, (i + 1) * tasks):
            system.rename(hadoop.Path(f"{base}/all/part-{n:05d}"), target)
    back = readers.read_keyed_binary(
        spark, base + "/{first}/1*/*", "([^_]+)_(.+)", ("spu_id", "goods_no"),
        path_pattern=r"/(\d+)/(\d+)/(\d+)/[^/]+$",
        path_names=("first_category", "second_category", "third_category"),
        values={"first": "*0"})
    return back.select("key", "spu_id", "goods_no", F.md5("value").alias("digest"),
                       "first_category", "second_category", "third_category")


@query("io_tfrecord_partitioned", "select o_orderkey, o_orderstatus from orders")
def io_tfrecord_partitioned(spark, folder):
    """Records in folders of two depths, read by the folder above them."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch(spark, "records")
    tfrecord.write_tfrecord(orders.where("o_orderkey % 2 = 0"), f"{path}/even=1", "append")
    tfrecord.write_tfrecord(orders.where("o_orderkey % 2 = 1"), f"{path}/even=0/deep=1", "append")
    return tfrecord.read_tfrecord(spark, path, orders.schema)


@query("io_tfrecord_split", """
select o_orderkey, o_orderstatus, floor(o_totalprice)::int as price, true as many_tasks from orders""")
def io_tfrecord_split(spark, folder):
    """All orders in one file, which many tasks read."""
    path = scratch(spark, "records")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("int").alias("price"))
    tfrecord.write_tfrecord(orders.coalesce(1), path, "error")
    back = tfrecord.read_tfrecord(spark, path, orders.schema, split=8 << 10)
    read = back.withColumn("task", F.spark_partition_id())
    tasks = read.agg(F.count_distinct("task").alias("n")).scalar()
    return read.withColumn("many_tasks", tasks >= 8).drop("task")
