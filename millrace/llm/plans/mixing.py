"""The mix of all documents, and the same in SQL."""

from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.plans import query, table
from millrace.llm.text import words

SQL = r"""
with d as (
  select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
o as (
  select *, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over (order by source_size / weight::double, source nulls last
      rows between unbounded preceding and 1 preceding), 0) as full_before,
    sum(weight) over (order by source_size / weight::double, source nulls last
      rows between current row and unbounded following) as weight_left
  from w),
f as (
  select *, 3 * source_size * weight_left <= weight * (total - full_before) as filled from o),
t as (
  select source, source_size, case when filled then (3 * source_size)::double
    else (weight * (total - coalesce(sum(case when filled then 3 * source_size end) over (), 0)))
      ::bigint::double / (sum(case when not filled then weight end) over ())::bigint::double
    end as target
  from f),
r as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id
      rows between unbounded preceding and 1 preceding), 0)::bigint as earlier
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else (budget // source_size) * size
     + greatest(0, least(size, budget % source_size - earlier)) end)::bigint as taken
from r"""


@query("op6_mix_sources", SQL)
def op6_mix_sources(spark, folder):
    documents = table(spark, folder, "documents")
    sized = documents.select("doc_id", "source", F.size(words(F.col("text"))).alias("size"))
    return (mixing.mix(sized, "doc_id", "source", "size")
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"))
