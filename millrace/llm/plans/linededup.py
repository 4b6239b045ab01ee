"""Lines of many documents dropped everywhere, and the same in SQL."""

from pyspark.sql import functions as F

from millrace.llm import linededup
from millrace.llm.plans import query, table

SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (
  select doc_id, i, ls[i] as line, translate(regexp_replace(regexp_replace(ls[i],
      '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
hot as (
  select key from l where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select l.*, hot.key is not null as lost from l left join hot on l.key = hot.key)
select doc_id, count(*)::bigint as n_lines,
  sum(case when lost then 1 else 0 end)::bigint as n_dropped,
  sha256(coalesce(string_agg(case when lost then null else line end, chr(10) order by i), ''))
    as kept_sha256
from m group by doc_id"""


@query("op8_line_dedup", SQL)
def op8_line_dedup(spark, folder):
    kept = linededup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2("text", 256).alias("kept_sha256"))
