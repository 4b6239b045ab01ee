import collections

import odd
from pyspark.sql import functions as F

from millrace.llm import linededup, mixing, rules


def test_rules_keep_other_columns(spark):
    docs = odd.documents(spark)
    judged = rules.apply_rules(docs)
    assert judged.count() == docs.count()
    assert {c for c in docs.columns if c not in ("n_words", "kept")} <= set(judged.columns)
    null = judged.where("doc_id = 1").first()
    assert (null.n_words, null.word_chars, null.base_failed, null.kept) == (0, 0, True, False)
    assert null._words == "0"


def test_repeated_words_by_brute_force(spark):
    def brute(text):
        w = odd.words(text) if text is None else [
            x for x in text.encode().split()]
        grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        inside = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i:i + 3])] > 1:
                inside |= {i, i + 1, i + 2}
        return len(inside)
    docs = odd.documents(spark)
    for row in rules.apply_rules(docs).select("text", "n_repeat_words").collect():
        assert row.n_repeat_words == brute(row.text)


def test_a_rule_decides(spark):
    docs = spark.createDataFrame([(1, "good " * 5), (2, "b#d " * 5)], "doc_id long, text string")
    kept = rules.apply_rules(docs, base=(), rules=[rules.Rule("few", "symbols_per_word", most=0.5)])
    assert {r.doc_id: r.kept for r in kept.collect()} == {1: True, 2: False}


def _lines(text):
    return (text or "").split("\n")


def test_dropped_lines_by_brute_force(spark):
    docs = odd.documents(spark)
    rows = docs.select("doc_id", "text").collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = collections.Counter(k for r in rows for k in {key(x) for x in _lines(r.text)} if k)
    want = collections.Counter()
    for r in rows:
        kept = [x for x in _lines(r.text) if seen[key(x)] < 2]
        want[r.doc_id, "\n".join(kept), len(_lines(r.text)), len(_lines(r.text)) - len(kept)] += 1
    got = linededup.dedup_lines(docs, least_docs=2)
    assert {"_row", "_lost", "_input", "lang"} <= set(got.columns)
    assert want == collections.Counter(
        (r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_compact_and_leave_out_known_keys(spark):
    store = linededup.LineRuns(spark, least_docs=3, fanout=2, buckets=4)
    batch = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "line_hash long, line_check int, n_docs long")
    store.add(batch)
    assert [len(x) for x in store.levels] == [1]
    store.add(batch)
    assert [len(x) for x in store.levels] == [0, 1]
    assert [tuple(r) for r in store.unknown(batch).collect()] == [(2, 2, 1)]
    store.add(batch)
    assert [tuple(r) for r in store.frequent().orderBy("line_hash").collect()] == [(1, 1), (2, 2)]
    store.forget()


def test_runs_are_joined_without_moving_them(spark):
    store = linededup.LineRuns(spark, least_docs=1, fanout=2, buckets=8)
    batch = spark.range(100).selectExpr("id as line_hash", "cast(id as int) line_check", "1L n_docs")
    store.add(batch)
    store.add(batch)
    grouped = batch.groupBy(*linededup.HASH).agg(F.sum("n_docs").alias("n_docs"))
    plan = store.unknown(grouped)._jdf.queryExecution().executedPlan().toString()
    store.forget()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_mix_meets_targets(spark):
    rows = [(i, "a" if i < 900 else "b" if i < 950 else None, 1 + i % 7) for i in range(1000)]
    rows += [(5, "a", 6)] * 50 + [(None, "b", None), (None, None, 0)]
    df = spark.createDataFrame(rows, "i long, s string, n long")
    got = mixing.mix(df, "i", "s", "n", rows_per_range=20).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    total = sum(size.values())
    # a: weight 1, b: weight 2 and null: weight 3, both full at three times their size.
    assert target["b"] == 3 * size["b"] and target[None] == 3 * size[None]
    assert target["a"] == total - target["b"] - target[None]
    for s in size:
        assert taken[s] == int(target[s])
    again = mixing.mix(df.repartition(7), "i", "s", "n", rows_per_range=20)
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again.collect()))
