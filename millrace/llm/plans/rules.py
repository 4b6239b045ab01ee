"""Quality rules over all documents, and the same measures in SQL."""

from millrace.llm import rules
from millrace.llm.plans import query, table

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))

SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls
  from d),
grams as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (
  select doc_id, i from (
    select doc_id, i, count(*) over (partition by doc_id, gram) as n from grams) where n >= 2),
covered as (
  select doc_id, sum(least(3, coalesce(following - i, 3)))::bigint as n_repeat_words from (
    select doc_id, i, lead(i) over (partition by doc_id order by i) as following from twice)
  group by doc_id),
measured as (
  select w.doc_id, len(ws)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(regexp_extract_all(t, '!')) as n_exclamations,
    len([s for s in [{_STOP}] if list_contains(ws, s)]) as n_stop_words,
    len(ls) as n_lines,
    len([x for x in ls if starts_with(x, '- ') or starts_with(x, '* ')
      or starts_with(x, '• ')]) as n_bullets,
    len([x for x in ls if ends_with(x, '...') or ends_with(x, '…')]) as n_ellipses
  from w left join covered on w.doc_id = covered.doc_id),
based as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else
    word_chars / n_words::double >= 2 and word_chars / n_words::double <= 12
    and n_symbols / n_words::double <= 0.1 and n_exclamations / n_words::double <= 0.1
    and n_stop_words >= 2 and n_bullets / n_lines::double <= 0.9
    and n_ellipses / n_lines::double <= 0.3 and n_dup_lines / n_lines::double <= 0.6
  end as kept
from based"""


@query("op7_quality_rules", SQL)
def op7_quality_rules(spark, folder):
    judged = rules.apply_rules(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")
