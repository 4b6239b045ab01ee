"""All orders of five filters over all documents, and the same in SQL."""

from pyspark.sql import functions as F

from millrace.llm import filteraudit
from millrace.llm.plans import query, table

SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents),
firsts as (select t, min(doc_id) as first from w group by t),
marks as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic
  from labels group by doc_id),
f as (
  select w.part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (case when len(ws) < 100 then 1 else 0 end)
    + (case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t)
         then 4 else 0 end)
    + (case when regexp_matches(w.t, '[#$%&*|]') then 8 else 0 end)
    + (case when w.doc_id > first then 16 else 0 end) as fails
  from w join firsts on w.t = firsts.t left join marks on w.doc_id = marks.doc_id),
kinds as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f
  group by part, fails),
parts as (select distinct part from kinds),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bits[step] as own,
    coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from orders, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (fails & (before | own) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (fails & own <> 0 and fails & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (fails & own <> 0 and fails & before <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (fails & own <> 0 and fails & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (fails & own <> 0 and fails & before = 0), 0)::bigint as toxic_lost
  from steps, parts join kinds using (part) group by part, filter_order, step, own)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost,
  toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from r"""


@query("op12_filter_audit", SQL)
def op12_filter_audit(spark, folder):
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("doc"), (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"))
    return filteraudit.audit(table(spark, folder, "documents"), labels).drop("filter")
