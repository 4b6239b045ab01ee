import numpy as np
import odd
from pyspark.sql import functions as F

from millrace.llm import langid

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", langid.is_held_out(F.col("doc_id")))
    net = langid.fit(marked.where(~F.col("held_out")))
    judged = langid.predict(marked, net).where("held_out")
    right, n = judged.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")),
                             F.count("*")).first()
    assert n > 200 and right / n > 0.97
    again = langid.fit(marked.where(~F.col("held_out")).repartition(5))
    assert np.array_equal(again.out, net.out)


def _network(labels=("a", "b"), window=32):
    r = np.random.default_rng(0)
    rows = [bytes(r.integers(97, 105, 30, dtype=np.uint8)) for _ in range(100)]
    rows += [bytes(r.integers(105, 113, 30, dtype=np.uint8)) for _ in range(100)]
    windows = np.concatenate([langid.cut(b, window) for b in rows])
    return langid.train(windows, ["a"] * 100 + ["b"] * 100, epochs=4)


def test_responses_are_the_convolution():
    net = _network()
    windows = langid.cut(b"abcdefghijklmnop" * 4, 32)
    slow = []
    for width, f in net.filters.items():
        for w in windows:
            responses = [sum(f[d][w[i + d]] for d in range(width)) for i in range(32 - width + 1)]
            slow.append(np.max(responses, axis=0))
    n = len(windows)
    slow = np.concatenate([np.array(slow[i * n:(i + 1) * n]) for i in range(3)], axis=1)
    assert np.allclose(net.responses(windows), slow, atol=1e-5)


def test_gradients_by_differences():
    r = np.random.default_rng(1)
    x, t = r.integers(0, 4, (6, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    net = langid.train(x, ["a", "b"] * 3, filters=2, epochs=1)

    def loss():
        p = net.probabilities(x)
        return -np.log(p[np.arange(6), t]).mean()
    gradients = langid._gradients(net, x, t)
    for p, g in zip([*net.filters.values(), net.bias, net.out, net.out_bias], gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-2
        net.tables.clear()
        up = loss()
        p[at] -= 2e-2
        net.tables.clear()
        down = loss()
        p[at] += 1e-2
        net.tables.clear()
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_awkward_texts(spark):
    docs = odd.documents(spark)
    judged = langid.predict(docs, _network())
    assert set(docs.columns) <= set(judged.columns) and judged.count() == docs.count()
    rows = judged.select("doc_id", "text", "lang_pred", "score").collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered)
        assert 0 <= r.score <= 1 and (lettered or r.score == 0)
    same = {(r.lang_pred, r.score) for r in rows if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(docs.where("lang is null")) is None


def test_the_whole_text_counts(spark):
    net = _network()
    df = spark.createDataFrame([("abcdefg " * 2 + "ijklmno " * 5000,), ("abcdefg " * 400,)], "text string")
    assert [r.lang_pred for r in langid.predict(df, net).collect()] == ["b", "a"]


def test_sample_is_bounded(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"))
    found = langid.sample_windows(df, "text", "lang", "doc_id", 20, 1, 32)
    counts = {n: sum(1 for _, m in found if m == n) for n in "xy"}
    assert all(10 <= c <= 20 for c in counts.values())
