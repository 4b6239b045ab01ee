"""Word vectors that no driver holds."""

import random

import numpy as np
import pytest
from pyspark.ml import feature as mlf
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace import util
from millrace.ml import features as fe
from millrace.ml import vocabulary, wordvectors
from millrace.ml.persist import load_fitted, save_fitted
from millrace.ml.stages import recording


@pytest.mark.parametrize("shard, apart", [(1 << 19, 0.5), (3000, 0.05)])
def test_words_of_one_context_are_alike(spark, tmp_path, monkeypatch, shard, apart):
    monkeypatch.setattr(mlf, "Word2Vec", None)  # its fit holds the vocabulary on the driver
    r = random.Random(2)
    groups = [[f"{name}{i}" for i in range(6)] for name in ("a", "b")]
    rows = [(n, [r.choice(groups[n % 2]) for _ in range(30)]) for n in range(400)]
    rows += [(400, ["once", "a1", "a2"]), (401, []), (402, None)]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    monkeypatch.setattr(wordvectors, "_SHARD", shard)
    with recording() as stages:
        found = fe.word2vec(df, "w", "v", vectorSize=6, minCount=2, maxIter=4, seed=1, numPartitions=2,
                            stepSize=0.1)
    vectors = {r.word: np.array(r.vector) for r in stages[-1].vectors.collect()}
    assert set(vectors) == {w for g in groups for w in g}

    def like(x, y):
        x, y = vectors[x], vectors[y]
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))
    same = [like(g[i], g[j]) for g in groups for i in range(6) for j in range(i)]
    across = [like(x, y) for x in groups[0] for y in groups[1]]
    assert np.mean(same) > np.mean(across) + apart
    got = {r.k: r.v for r in found.select("k", vector_to_array("v").alias("v")).collect()}
    assert len(got) == len(rows) and got[401] == got[402] == [0.0] * 6
    assert np.allclose(got[400], (vectors["a1"] + vectors["a2"]) / 3, atol=1e-6)
    assert np.allclose(got[7], np.mean([vectors[w] for w in rows[7][1]], axis=0), atol=1e-6)
    save_fitted(stages, str(tmp_path / "saved"))
    again = load_fitted(str(tmp_path / "saved")).transform(df.drop("v")).where("k = 7")
    assert again.select(F.get(vector_to_array("v"), F.lit(0))).first()[0] == pytest.approx(got[7][0])


def test_unknown_choices_are_named(spark):
    df = spark.createDataFrame([(["a"],)], "w array<string>")
    with pytest.raises(ValueError, match="depth"):
        fe.word2vec(df, "w", "v", depth=1)


def test_a_single_pass_keeps_and_sends_no_texts(spark, monkeypatch):
    kept = []
    for module in (wordvectors, vocabulary):
        monkeypatch.setattr(module, "written", lambda df, label: (kept.append(label), util.written(df, label))[1])
    monkeypatch.setattr(wordvectors, "_COMMON", 160)  # two words of eight numbers
    rows = [(1, ["a", "b", "a"]), (2, ["a", "b", "a"]), (3, None), (4, []), (5, ["c", None, "d"]),
            (6, ["a"]), (7, ["e", "b", "d"]), (8, [None])]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    with recording() as stages:
        found = fe.word2vec(df, "w", "v", vectorSize=8, minCount=0, seed=3, numPartitions=2)
    got = {r.k: r.v for r in found.select("k", vector_to_array("v").alias("v")).collect()}
    assert kept == ["word-vectors"]
    vectors = {r.word: (r.n, np.array(r.vector)) for r in stages[-1].vectors.collect()}
    assert {w: n for w, (n, _) in vectors.items()} == {"a": 5, "b": 3, "c": 1, "d": 2, "e": 1}
    for k, words in rows:
        known = [vectors[w][1] for w in words or [] if w]
        assert np.allclose(got[k], sum(known, np.zeros(8)) / max(1, len(words or [])), atol=1e-9), k
