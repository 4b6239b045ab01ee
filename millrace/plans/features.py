"""Feature engineering. Vectors are compared element by element."""

from statistics import NormalDist

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from millrace.ml import features as fe
from millrace.ml.models import make_estimator, train
from millrace.ml.stages import recording
from millrace.ml.wordvectors import average, summed, with_words
from millrace.plans.registry import query, table
from millrace.util import written


def _slots(df, keys, vector, digits=6, name="x"):
    """One row per key and vector element."""
    return df.select(*keys, F.posexplode(vector_to_array(vector)).alias("slot", name)).withColumn(
        name, F.round(name, digits))


def _stored(df, keys, vector, name):
    """One row per key and element that a sparse vector holds and that is not 0."""
    parts = F.unwrap_udt(vector)
    return df.select(*keys, F.inline(F.arrays_zip(parts["indices"].alias("slot"), parts["values"].alias(
        name)))).where(F.col(name) != 0)


def _element(vector, i, digits=6):
    return F.round(F.get(vector_to_array(vector), F.lit(i)), digits)


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", "label",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


SLOTS = """select vec_id, unnest(embedding)::double as x,
  unnest(generate_series(0, len(embedding) - 1))::int as slot from embeddings"""
LINE = ["l_orderkey", "l_partkey", "l_suppkey"]
LINE_SQL = "l_orderkey, l_partkey, l_suppkey"

# --- Categories -------------------------------------------------------------


def _index_sql(table_name, column):
    return f"""(select {column} as v, (row_number() over (order by count(*) desc, {column}) - 1)
    ::double as i from {table_name} group by 1)"""


@query("string_index", f"""
select o_orderkey, p.i as "o_orderpriority_IDX", s.i as "o_orderstatus_IDX" from orders
join {_index_sql('orders', 'o_orderpriority')} p on p.v = o_orderpriority
join {_index_sql('orders', 'o_orderstatus')} s on s.v = o_orderstatus""")
def string_index(spark, folder):
    orders = table(spark, folder, "orders")
    return fe.string_index(orders, ["o_orderpriority", "o_orderstatus"]).select(
        "o_orderkey", "o_orderpriority_IDX", "o_orderstatus_IDX")


@query("string_index_distributed", f"""
select o_orderkey, i as "o_custkey_IDX" from orders
join (select v, (row_number() over (order by n desc, v) - 1)::double as i
      from (select o_custkey::varchar as v, count(*) as n from orders group by 1))
  on v = o_custkey::varchar""")
def string_index_distributed(spark, folder):
    """The way taken when there are too many labels for the driver."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return fe.string_index(orders, "o_custkey", distributed=True).select("o_orderkey", "o_custkey_IDX")


@query("string_index_keep", """
select o_orderkey, case when o_orderstatus = 'F' then n else i end as "status_IDX"
from (select o_orderkey, o_orderstatus from orders)
left join (select o_orderstatus as v, (row_number() over (order by count(*) desc, o_orderstatus) - 1)
           ::double as i from orders where o_orderstatus <> 'F' group by 1) on v = o_orderstatus,
(select (count(distinct o_orderstatus) - 1)::double as n from orders)""")
def string_index_keep(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return fe.string_index(orders, "status", "keep").select("o_orderkey", "status_IDX")


@query("index_to_string", "select o_orderkey, o_orderpriority as label from orders")
def index_to_string(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    indexer = make_estimator("string_indexer", inputCol="o_orderpriority", outputCol="idx")
    model = train(indexer, orders)
    indexed = model.transform(orders).select("o_orderkey", "idx")
    return fe.index_to_string(indexed, "idx", "label", model).select("o_orderkey", "label")


@query("one_hot", f"""
select o_orderkey, (p.i = 0)::int || ',' || (p.i = 1)::int || ',' || (p.i = 2)::int || ',' ||
  (p.i = 3)::int as code
from orders join {_index_sql('orders', 'o_orderpriority')} p on p.v = o_orderpriority""")
def one_hot(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    coded = fe.one_hot(fe.string_index(orders, "o_orderpriority"), ["o_orderpriority_IDX"])
    code = vector_to_array("o_orderpriority_IDX_E").cast("array<int>").cast("array<string>")
    return coded.select("o_orderkey", F.array_join(code, ",").alias("code"))


HASHED = ["l_quantity", "l_tax", "l_returnflag", "l_linenumber"]


@query("feature_hash", """
select count(*) as n, 0::bigint as n_wrong, 0::bigint as n_not_own, true as spread from lineitem""")
def feature_hash(spark, folder):
    """The columns hashed together are the sum of each hashed alone: a number in the slot of its
    column, a 1 in a slot for each category."""
    lines = table(spark, folder, "lineitem").select(*HASHED)

    def hashed(df, columns, out):
        some = [c for c in columns if c == "l_linenumber"]
        return fe.feature_hash(df, columns, out, categorical=some, numFeatures=64)
    wide = hashed(lines, HASHED, "all")
    for c in HASHED:
        wide = hashed(wide, [c], f"h_{c}")
    vectors = ["all", *[f"h_{c}" for c in HASHED]]
    # Every row is hashed; rows that came out alike are counted, and checked once.
    alike = wide.groupBy(*HASHED, *[F.unwrap_udt(c).alias(c) for c in vectors]).agg(
        F.count(F.lit(1)).alias("rows"))

    def dense(c):
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.get(
            F.col(c)["values"], F.array_position(F.col(c)["indices"], i).cast("int") - 1), F.lit(0.0)))
    arrays = {c: dense(c) for c in vectors}
    total = arrays["h_" + HASHED[0]]
    for c in HASHED[1:]:
        total = F.zip_with(total, arrays[f"h_{c}"], lambda a, b: a + b)
    away = F.exists(F.zip_with(total, arrays["all"], lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)

    def alone(c, value):
        used = F.filter(arrays[f"h_{c}"], lambda x: x != 0)
        return F.when(value == 0, F.size(used) == 0).otherwise(
            (F.size(used) == 1) & (F.get(used, F.lit(0)) == value))
    own = (alone("l_quantity", F.col("l_quantity")) & alone("l_tax", F.col("l_tax"))
           & alone("l_returnflag", F.lit(1.0)) & alone("l_linenumber", F.lit(1.0)))
    slots = {c: F.array_position(F.transform(arrays[f"h_{c}"], lambda x: x != 0), True)
             for c in HASHED}
    # Two numbers have one slot each; three flags and seven lines have several.
    def counted(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0).cast("bigint"))
    return alike.agg(
        counted(F.lit(True)).alias("n"), counted(away).alias("n_wrong"), counted(~own).alias("n_not_own"),
        ((F.count_distinct(F.when(F.col("l_quantity") != 0, slots["l_quantity"])) == 1)
         & (F.count_distinct(slots["l_returnflag"]) >= 2)
         & (F.count_distinct(slots["l_linenumber"]) >= 4)).alias("spread"))


# --- Vectors ----------------------------------------------------------------

FIVE = ["l_tax", "l_quantity", "l_discount", "l_extendedprice", "l_linenumber"]


@query("assemble", f"""
select {LINE_SQL}, unnest([l_tax, l_quantity, l_discount, l_extendedprice, l_linenumber::double])
  as x, unnest([0, 1, 2, 3, 4])::int as slot from lineitem""")
def assemble(spark, folder):
    return _slots(fe.assemble(table(spark, folder, "lineitem"), FIVE, "v", keep=False), LINE, "v")


@query("normalize_cols", f"""
select {LINE_SQL}, round(l_quantity / sqrt(l_quantity * l_quantity + l_discount * l_discount), 6)
  as a, round(l_discount / sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) as b
from lineitem""")
def normalize_cols(spark, folder):
    scaled = fe.normalize(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"])
    vector = "l_quantity_l_discount_TMP_N"
    return scaled.select(*LINE, _element(vector, 0).alias("a"), _element(vector, 1).alias("b"))


@query("normalize_vec", f"""
with v as ({SLOTS}), m as (select vec_id, max(abs(x)) as top from v group by 1)
select vec_id, slot, round(x / top, 6) as x from v join m using (vec_id)""")
def normalize_vec(spark, folder):
    return _slots(fe.normalize(_embeddings(spark, folder), "features", "n", p="inf-norm"),
                  ["vec_id"], "n")


@query("max_abs_scale", f"""
with v as ({SLOTS}), m as (select slot, max(abs(x)) as top from v group by 1)
select vec_id, slot, round(x / top, 6) as x from v join m using (slot)""")
def max_abs_scale(spark, folder):
    return _slots(fe.max_abs_scale(_embeddings(spark, folder), "features", "s"), ["vec_id"], "s")


@query("max_abs_scale_cols", f"""
select {LINE_SQL}, round(l_quantity / (select max(l_quantity) from lineitem), 6) as a,
  round(l_extendedprice / (select max(l_extendedprice) from lineitem), 6) as b from lineitem""")
def max_abs_scale_cols(spark, folder):
    scaled = fe.max_abs_scale(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    vector = "l_quantity_l_extendedprice_TMP_MAS"
    return scaled.select(*LINE, _element(vector, 0).alias("a"), _element(vector, 1).alias("b"))


@query("min_max_scale", f"""
with v as ({SLOTS}), m as (select slot, min(x) as lo, max(x) as hi from v group by 1)
select vec_id, slot, round((x - lo) / (hi - lo) * 3 - 1, 6) as x from v join m using (slot)""")
def min_max_scale(spark, folder):
    return _slots(fe.min_max_scale(_embeddings(spark, folder), "features", "s", -1.0, 2.0),
                  ["vec_id"], "s")


@query("min_max_scale_cols", f"""
with m as (select min(l_quantity) as a0, max(l_quantity) as a1, min(l_extendedprice) as b0,
  max(l_extendedprice) as b1 from lineitem)
select {LINE_SQL}, round((l_quantity - a0) / (a1 - a0), 6) as a,
  round((l_extendedprice - b0) / (b1 - b0), 6) as b from lineitem, m""")
def min_max_scale_cols(spark, folder):
    scaled = fe.min_max_scale(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    vector = "l_quantity_l_extendedprice_TMP_MMS"
    return scaled.select(*LINE, _element(vector, 0).alias("a"), _element(vector, 1).alias("b"))


@query("standard_scale", """
with m as (select avg(l_quantity) as a, stddev_samp(l_quantity) as sa, avg(l_extendedprice) as b,
  stddev_samp(l_extendedprice) as sb from lineitem)
select l_orderkey, l_partkey, l_suppkey, round((l_quantity - a) / sa, 6) as a,
  round((l_extendedprice - b) / sb, 6) as b from lineitem, m""")
def standard_scale(spark, folder):
    vectors = fe.assemble(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], "v")
    scaled = fe.standard_scale(vectors, "v", "s", withMean=True)
    return scaled.select(*LINE, _element("s", 0).alias("a"), _element("s", 1).alias("b"))


# All components together are a rotation: the total variance stays what it was.
@query("pca", f"""
select (select count(*) from embeddings) as n, max(slot) + 1 as k, true as ordered,
  true as independent, round(sum(v), 6) as total
from (select slot, var_samp(x) as v from ({SLOTS}) group by slot)""")
def pca(spark, folder):
    projected = fe.pca(_embeddings(spark, folder), "features", 64, "pc")
    return _rotation(projected, "pc", 64, 6)


@query("pca_cols", """
select count(*) as n, 3 as k, true as ordered, true as independent,
  round(var_samp(l_quantity) + var_samp(l_extendedprice / 1000) + var_samp(l_tax), 4) as total
from lineitem""")
def pca_cols(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    projected = fe.pca(lines, ["l_quantity", "price", "l_tax"], 3)
    return _rotation(projected, "l_quantity_price_l_tax_P", 3, 4)


def _rotation(projected, vector, k, digits):
    values = vector_to_array(vector)
    parts = projected.select(F.size(values).alias("k"),
                             *[F.get(values, F.lit(i)).alias(f"c{i}") for i in range(k)])
    facts = parts.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"),
                      F.array(*[F.var_samp(f"c{i}") for i in range(k)]).alias("v"),
                      F.covar_samp("c0", "c1").alias("c"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return facts.select(
        "n", "k", (F.reverse(F.array_sort(F.transform("v", lambda x: F.round(x, 9))))
                   == F.transform("v", lambda x: F.round(x, 9))).alias("ordered"),
        (F.abs("c") < 1e-6 * total).alias("independent"), F.round(total, digits).alias("total"))


@query("vector_index", f"""
select {LINE_SQL}, (dense_rank() over (order by l_linenumber) - 1)::double as a, l_quantity as b
from lineitem""")
def vector_index(spark, folder):
    vectors = fe.assemble(table(spark, folder, "lineitem"), ["l_linenumber", "l_quantity"], "v")
    indexed = fe.vector_index(vectors, "v", "i", maxCategories=10)
    return indexed.select(*LINE, _element("i", 0).alias("a"), _element("i", 1).alias("b"))


@query("vector_slice", """
select vec_id, round(embedding[8]::double, 6) as a, round(embedding[2]::double, 6) as b
from embeddings""")
def vector_slice(spark, folder):
    sliced = fe.vector_slice(_embeddings(spark, folder), "features", "part", indices=[7, 1])
    return sliced.select("vec_id", _element("part", 0).alias("a"), _element("part", 1).alias("b"))


@query("vector_slice_names", f"select {LINE_SQL}, l_discount as a from lineitem")
def vector_slice_names(spark, folder):
    vectors = fe.assemble(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"], "v")
    sliced = fe.vector_slice(vectors, "v", "part", slots=["l_discount"])
    return sliced.select(*LINE, _element("part", 0).alias("a"))


FLAGS = """select doc_id, quality, [(lang = 'en')::int, (n_chars > 1500)::int,
  (source in ('src1', 'src2', 'src3'))::int] as f from labels join documents using (doc_id)"""


def _flags(spark, folder):
    both = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    tests = [F.col("lang") == "en", F.col("n_chars") > 1500,
             F.col("source").isin("src1", "src2", "src3")]
    return both.select("doc_id", F.col("quality").cast("double").alias("quality"),
                       array_to_vector(F.array(*[t.cast("double") for t in tests])).alias("f"))


CHI = f"""
with d as (select doc_id, quality, unnest(f) as x, unnest([0, 1, 2]) as slot from ({FLAGS})),
t as (select slot, x, quality, count(*)::double as o from d group by all),
cells as (select a.slot, a.x, b.quality, a.n * b.n / c.n as e from
  (select slot, x, count(*)::double as n from d group by all) a
  join (select slot, quality, count(*)::double as n from d group by all) b using (slot)
  join (select slot, count(*)::double as n from d group by all) c using (slot)),
chi as (select cells.slot, sum((coalesce(o, 0) - e) ** 2 / e) as statistic
  from cells left join t using (slot, x, quality) group by 1)"""


@query("chisq_stat", f"{CHI} select slot::int as slot, round(statistic, 6) as statistic from chi")
def chisq_stat(spark, folder):
    found = ChiSquareTest.test(_flags(spark, folder), "f", "quality", flatten=True)
    return found.select(F.col("featureIndex").alias("slot"),
                        F.round("statistic", 6).alias("statistic"))


@query("chisq_select", f"""{CHI}
select doc_id, x::double as x from d
where slot = (select slot from chi order by statistic desc limit 1)""")
def chisq_select(spark, folder):
    kept = fe.chisq_select(_flags(spark, folder), "f", "quality", "best", threshold=1)
    return kept.select("doc_id", _element("best", 0).alias("x"))


@query("chisq_select_percentile", f"""{CHI}
select doc_id, (select floor(0.7 * count(*))::bigint from chi) as n_kept from d where slot = 0""")
def chisq_select_percentile(spark, folder):
    kept = fe.chisq_select(_flags(spark, folder), "f", "quality", "best", "percentile", 0.7)
    return kept.select("doc_id", F.size(vector_to_array("best")).cast("bigint").alias("n_kept"))


# Fixed value: a statistic with one degree of freedom above this has a p-value below 0.05.
CHI_5_PERCENT = 3.841458820694124


@query("chisq_select_fpr", f"""{CHI}
select doc_id, (select count(*) from chi where statistic > {CHI_5_PERCENT}) as n_kept
from d where slot = 0""")
def chisq_select_fpr(spark, folder):
    kept = fe.chisq_select(_flags(spark, folder), "f", "quality", "best", "fpr", 0.05)
    return kept.select("doc_id", F.size(vector_to_array("best")).cast("bigint").alias("n_kept"))


def _critical(p: float) -> float:
    """The statistic with one degree of freedom whose p-value is ``p``."""
    return NormalDist().inv_cdf(1 - p / 2) ** 2


def _limits(share) -> str:
    """A table (k, i, least): the least statistic of the i-th best of k features."""
    cells = [f"({k}, {i}, {_critical(share(i, k))!r})" for k in range(1, 9) for i in range(1, k + 1)]
    return "(values " + ", ".join(cells) + ") as limits(k, i, least)"


RANKED = f"""{CHI}, ranked as (
  select statistic, row_number() over (order by statistic desc) as i, count(*) over () as k from chi)
select doc_id, (select coalesce(max(ranked.i), 0)::bigint from ranked join {{limits}}
  on ranked.i = limits.i and ranked.k = limits.k where statistic >= least) as n_kept
from d where slot = 0"""


@query("chisq_select_fdr", RANKED.format(limits=_limits(lambda i, k: 0.05 * i / k)))
def chisq_select_fdr(spark, folder):
    kept = fe.chisq_select(_flags(spark, folder), "f", "quality", "best", "fdr", 0.05)
    return kept.select("doc_id", F.size(vector_to_array("best")).cast("bigint").alias("n_kept"))


@query("chisq_select_fwe", RANKED.format(limits=_limits(lambda i, k: 0.05 / k)))
def chisq_select_fwe(spark, folder):
    kept = fe.chisq_select(_flags(spark, folder), "f", "quality", "best", "fwe", 0.05)
    return kept.select("doc_id", F.size(vector_to_array("best")).cast("bigint").alias("n_kept"))


# --- Numbers ----------------------------------------------------------------

@query("binarize", f"""
select {LINE_SQL}, (l_quantity > 25)::int::double as "l_quantity_B",
  (l_discount > 0.05)::int::double as "l_discount_B" from lineitem""")
def binarize(spark, folder):
    flags = fe.binarize(table(spark, folder, "lineitem"), [("l_quantity", 25),
                                                           ("l_discount", 0.05)])
    return flags.select(*LINE, "l_quantity_B", "l_discount_B")


@query("bucketize", f"""
select {LINE_SQL}, case when l_quantity < 10 then 0.0 when l_quantity < 25 then 1 else 2 end::double
  as "l_quantity_B", case when l_tax < 10 then 0.0 else 1 end::double as "l_tax_B" from lineitem""")
def bucketize(spark, folder):
    buckets = fe.bucketize(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"],
                           "-INF, 10, 25, +INF")
    return buckets.select(*LINE, "l_quantity_B", "l_tax_B")


# --- Text -------------------------------------------------------------------

WORDS = """select doc_id, regexp_split_to_array(regexp_replace(lower(text), '\\s+$', ''), '\\s') as w
  from documents"""


def _words(spark, folder):
    return fe.tokenize(table(spark, folder, "documents").select("doc_id", "text"), ["text"])


@query("tokenize", f"""
select doc_id, len(w)::int as n, md5(array_to_string(w, ' ')) as digest from ({WORDS})""")
def tokenize(spark, folder):
    return _words(spark, folder).select(
        "doc_id", F.size("text__output").alias("n"),
        F.md5(F.array_join("text__output", " ").cast("binary")).alias("digest"))


STOP = ["the", "of", "and", "la", "les", "der", "die", "el"]


@query("stop_words", f"""
select doc_id, len(list_filter(w, lambda x: not list_contains({STOP}, x)))::int as n
from ({WORDS})""")
def stop_words(spark, folder):
    kept = fe.remove_stop_words(_words(spark, folder), "text__output", "kept", STOP)
    return kept.select("doc_id", F.size("kept").alias("n"))


@query("hashing_tf", f"""
with d as (select doc_id, unnest(w) as x from ({WORDS}))
select (select count(*) from documents) as n, 0::bigint as n_wrong, 0::bigint as n_not_one,
  (select count(*) from (select distinct x from d)) as n_words, true as spread""")
def hashing_tf(spark, folder):
    """A text's slots are the sums of its words' own slots, and these are spread."""
    size, words = 128, _words(spark, folder)
    counted = fe.hashing_tf(words, "text__output", "tf", numFeatures=size)
    terms = words.select("doc_id", F.explode("text__output").alias("x"))
    single = fe.hashing_tf(terms.select("x").distinct().withColumn("w", F.array("x")), "w", "tf",
                           numFeatures=size)
    learned = _stored(single, ["x"], "tf", "one")
    per_word = written(learned.groupBy("x").agg(
        F.count(F.lit(1)).alias("k"), F.max("one").alias("one"), F.max("slot").alias("slot")), "slots")
    expected = terms.groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("c")).join(
        per_word, "x").groupBy("doc_id", "slot").agg(F.sum("c").alias("c"))
    found = _stored(counted, ["doc_id"], "tf", "n")
    wrong = found.join(expected, ["doc_id", "slot"], "full").agg(F.count_if(
        F.coalesce(F.col("n") != F.col("c"), F.lit(True))).alias("n_wrong"))
    # Evenly spread words: no slot has five times its share and ten words more.
    loads = per_word.groupBy("slot").agg(F.count(F.lit(1)).alias("load"))
    crowd = loads.agg((F.max("load") <= 5 * F.sum("load") / size + 10).alias("spread"))
    return per_word.agg(F.count(F.lit(1)).alias("n_words"),
                        F.count_if((F.col("k") != 1) | (F.col("one") != 1)).alias("n_not_one")).select(
        counted.agg(F.count(F.lit(1))).scalar().alias("n"), wrong.scalar().alias("n_wrong"),
        "n_not_one", "n_words", crowd.scalar().alias("spread"))


@query("count_vectorize", f"""
with d as (select doc_id, unnest(w) as x from ({WORDS})),
vocabulary as (select x, row_number() over (order by count(*) desc, x) - 1 as slot from d group by x
  having count(distinct doc_id) >= 0.2 * (select count(*) from documents))
select doc_id, slot::int as slot, count(*)::double as n
from d join vocabulary using (x) group by doc_id, slot""")
def count_vectorize(spark, folder):
    """Every count in its slot; the slots are the ranks of the words."""
    counted = fe.count_vectorize(_words(spark, folder), "text__output", "tf", minDF=0.2)
    return _slots(counted, ["doc_id"], "tf", name="n").where("n > 0")


@query("word2vec", "select count(*) as n, 0::bigint as n_wrong, 0::bigint as n_zero, true as differ from documents")
def word2vec(spark, folder):
    """A text's vector is the average of its words' own vectors, which are not all alike."""
    words = _words(spark, folder)
    with recording() as stages:
        vectors = fe.word2vec(words, "text__output", "v", vectorSize=8, minCount=0, maxIter=1,
                              seed=7, numPartitions=8)
    terms = words.select("doc_id", F.explode("text__output").alias("word"))
    counts = terms.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("text__output", F.array("word"))
    own = vector_to_array("v").cast("array<float>").alias("own")
    single = written(stages[-1].transform(counts).select("word", "n", own), "own-vectors")
    checked = vectors.select("doc_id", vector_to_array("v").alias("v"))
    for part in summed(with_words(terms, single, 8), ["doc_id"], "own", 8, "sum"):
        checked = checked.join(part, "doc_id", "left")
    near = F.zip_with("v", average("sum", 8), lambda a, m: F.coalesce(
        F.abs(F.round(a, 9) - m) < 1e-5, F.lit(False)))
    wrong = F.coalesce(F.size(F.filter(near, lambda x: ~x)), F.size("v"))
    norms = single.select(F.aggregate("own", F.lit(0.0), lambda s, x: s + x * x).alias("q"),
                          F.get("own", F.lit(0)).alias("first"))
    return checked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wrong), F.lit(0)).alias("n_wrong")).select(
        "n", "n_wrong", norms.agg(F.count_if(F.col("q") == 0)).scalar().alias("n_zero"),
        norms.agg(F.stddev("first") > 1e-3).scalar().alias("differ"))
