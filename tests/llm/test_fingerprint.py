import hashlib
import random

import odd
import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprint

MASK = (1 << 64) - 1


def _chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little"), seed)
    return seed


def _brute(text: str, k=5, bins=64, keep=2) -> str:
    tokens = []
    for w in text.encode().split():
        word = w.decode()
        tokens += list(word) if len(word) > fingerprint.LONG_WORD else [word]
    hashes = [_chain([t.encode()]) for t in tokens]
    if not hashes:
        return ""
    grams = ([_chain(hashes[i:i + k]) for i in range(len(hashes) - k + 1)]
             if len(hashes) >= k else [_chain(hashes)])
    seen, full = {}, {}
    for place, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        if n:
            upper = (g if g < 1 << 63 else g - (1 << 64)) >> 28
            g = _chain([upper & MASK, n.to_bytes(4, "little")])
        element = g >> 29
        full.setdefault(element >> 29, []).append((element, place))
    out = []
    for b in sorted(full):
        chosen = sorted(full[b])[:keep]
        values = [e & (1 << 29) - 1 for e, _ in sorted(chosen, key=lambda x: x[1])]
        values += [MASK] * (keep - len(values))
        out.append(f"{(b << 32) | (_chain(values) >> 32):x}")
    return " ".join(out)


def test_fingerprints_by_brute_force(spark):
    rows = [(n, t) for n, (_, t) in enumerate(odd.texts())]
    rows += [(100 + i, r.text) for i, r in enumerate(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect())]
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(odd.documents(spark, rows)).collect()}
    rows.sort()
    for at, (i, t) in enumerate(rows):
        t, after = t or "", rows[(at + 1) % len(rows)][1] or ""
        tail = len(t) // 4
        edited = t[:len(t) - tail] + after[:tail]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == _brute(t) and r.edited_fingerprint == _brute(edited)
        assert r.near_next == _likeness(_brute(t), _brute(after))
        assert r.near_edited == _likeness(_brute(t), _brute(edited))


def _likeness(a: str, b: str) -> float:
    a, b = set(a.split()), set(b.split())
    used = {x[:-8] for x in a} | {x[:-8] for x in b}
    return len(a & b) / len(used) if used else 1.0


def test_order_matters(spark):
    r = random.Random(3)
    blocks = [" ".join(f"v{r.random()}" for _ in range(12)) for _ in range(30)]
    shuffled = blocks[15:] + blocks[:15]
    light = blocks[:29] + ["another ending"]
    df = spark.createDataFrame([(" ".join(blocks), " ".join(shuffled), " ".join(light))],
                               "a string, b string, c string")
    for c in "abc":
        df = fingerprint.order_minhash(df, c, f"f{c}")
    far, near = df.select(fingerprint.likeness(F.col("fa"), F.col("fb")),
                          fingerprint.likeness(F.col("fa"), F.col("fc"))).first()
    assert near > 0.85 and far < 0.75


def test_repeated_and_missing_ids(spark):
    docs = odd.documents(spark)
    got = fingerprint.fingerprint_edits(docs)
    assert got.count() == docs.count()
    same = got.where("doc_id = 6").collect()
    assert len(same) == 2 and same[0].fingerprint == same[1].fingerprint


def test_one_row(spark):
    row = fingerprint.fingerprint_edits(
        spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert row.near_next == 1.0


def test_no_shuffle_of_kmers(spark):
    plan = fingerprint.order_minhash(odd.documents(spark), "text", "f")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_columns_with_the_names_of_steps_are_kept(spark):
    from millrace.llm import fingerprint
    rows = [(1, "a b c d e f g h", *"123456"), (2, None, *"abcdef")]
    names = [f"_f_{c}" for c in "htgpqr"]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = fingerprint.order_minhash(df, "text", "f")
    assert got.columns == [*df.columns, "f"]
    assert [tuple(r)[2:8] for r in got.orderBy("doc_id").collect()] == [tuple("123456"), tuple("abcdef")]
    plain = fingerprint.order_minhash(df.select("doc_id", "text"), "text", "f")
    assert ([r["f"] for r in got.orderBy("doc_id").collect()]
            == [r["f"] for r in plain.orderBy("doc_id").collect()])
