"""All documents for filling in the middle, restored again, and the same in SQL."""

from pyspark.sql import functions as F

from millrace.llm import fim
from millrace.llm.plans import query, table

SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
w as (
  select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as ws,
    ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from d),
c as (
  select *, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) as a,
    greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
      or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from w),
s as (
  select *, array_to_string(ws[1:a], '') as p, array_to_string(ws[a + 1:b], '') as m,
    array_to_string(ws[b + 1:], '') as s
  from c)
select doc_id, len(ws)::bigint as n, form,
  case when form <> 'plain' then length(p)::bigint end as prefix_chars,
  case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from s"""


@query("op13_fill_in_middle", SQL)
def op13_fill_in_middle(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    made = fim.transform(documents).drop("text")
    return fim.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))
