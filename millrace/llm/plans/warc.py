"""Write all pages to WARC files and read them back."""

from millrace.llm import warc
from millrace.llm.plans import query, table
from millrace.util import scratch

SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages),
h as (
  select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as sha from p),
f as (select *, min(page_id) over (partition by sha) as first from h),
-- 160 bits in base 32: 32 digits, each five bits of the digest.
bits as (
  select *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (('0x' || substr(sha || '0', 1 + (5 * i) // 4, 2))::bigint >> (3 - (5 * i) % 4)) & 31)
    ::int, 1) for i in range(32)] as digits from f)
select page_id, payload_bytes, array_to_string(digits, '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from bits"""


@query("op2_warc_writer", SQL)
def op2_warc_writer(spark, folder):
    root = scratch(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), root)
    return warc.read_warc(spark, root).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
