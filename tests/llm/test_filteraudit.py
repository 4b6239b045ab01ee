import collections
from itertools import permutations

import odd
import pytest
from pyspark.sql import functions as F

from millrace.llm import filteraudit as fa

SCHEMA = "doc long, good boolean, toxic boolean"


def split(text):
    return (text or "").encode().split()


def fails(rows):
    """(part, failing letters) of each row, one by one."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, part in rows:
        t, w = t or "", split(t)
        bad = set()
        if len(w) < 100:
            bad.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            bad.add("C")
        if set(t) & set("#$%&*|"):
            bad.add("D")
        if i is not None and first[t] < i:
            bad.add("E")
        out.append((part or "", bad))
    return out


def brute(rows, labels):
    good = {d for d, g, _ in labels if g and d is not None}
    toxic = {d for d, _, x in labels if x and d is not None}
    judged = fails(rows)
    want, sums = {}, collections.Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, _ in judged}:
            left = [n for n, (p, _) in enumerate(judged) if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                out = [n for n in left if name in judged[n][1]]
                left = [n for n in left if name not in judged[n][1]]
                sums[part, name] += len(out)
                want[part, "".join(order), step] = [
                    len(left), len(out), sum(name in judged[n][1] for n in gone),
                    sum(judged[n] == (part, {name}) for n in range(len(judged))),
                    sum(rows[n][0] in good for n in out), sum(rows[n][0] in toxic for n in out)]
                gone += out
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def documents(spark):
    more = [(50, "SHOUT " * 120), (51, "one # two"), (52, "SHOUT " * 120), (53, "50% | SHOUT SHOUT"),
            (None, "SHOUT " * 120), (2, "50% | SHOUT SHOUT"), (54, " ".join(f"w{n}" for n in range(150)))]
    docs = odd.documents(spark, [*odd.texts(), *more])
    return docs, [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]


LABELS = [(1, True, False), (2, False, True), (6, True, True), (6, False, False), (50, True, None),
          (52, None, True), (52, True, None), (None, True, True), (53, None, None), (99, True, True)]


def result(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails,
                                               r.good_lost, r.toxic_lost, r.shapley)
            for r in frame.collect()}


def test_rows_by_brute_force(spark):
    docs, rows = documents(spark)
    labels = spark.createDataFrame(LABELS, SCHEMA)
    assert result(fa.audit(docs.repartition(3), labels)) == brute(rows, LABELS)


def test_without_labels_or_documents(spark):
    docs, rows = documents(spark)
    labels = spark.createDataFrame([], SCHEMA)
    assert result(fa.audit(docs, labels)) == brute(rows, [])
    assert fa.audit(docs.limit(0), labels).count() == 0


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "ab", "x"), (3, "b", None), (4, "", "x")],
                                 "doc_id long, text string, lang string")
    filters = {"1": lambda text, found: text.contains("a"), "2": lambda text, found: text.contains("b")}
    got = result(fa.audit(docs, spark.createDataFrame([], SCHEMA), filters=filters, copy=None))
    assert got["x", "12", 1] == (1, 2, 0, 1, 0, 0, 3) and got["x", "12", 2] == (1, 0, 1, 0, 0, 0, 1)
    assert got["x", "21", 1] == (2, 1, 0, 0, 0, 0, 1) and got["x", "21", 2] == (1, 1, 1, 1, 0, 0, 3)
    assert got["", "12", 2] == (0, 1, 0, 1, 0, 0, 2)
    with pytest.raises(ValueError, match="single"):
        fa.audit(docs, docs, filters={"AB": filters["1"]})


def test_joins_of_sets_move_ids_only(spark):
    docs, _ = documents(spark)
    facts = docs.select(F.monotonically_increasing_id().alias("id"), F.lit("x").alias("part"))
    failing = facts.select("id", "part", F.lit(True).alias("good"), F.lit(True).alias("toxic"),
                           F.lit("A").alias("filter"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fa._survivors(facts, failing, list("ABCDE"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
