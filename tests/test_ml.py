import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.ml import features as fe
from millrace.ml.models import make_estimator, make_evaluator, param_grid, score, train, tune
from millrace.ml.persist import fitted_stages, load_fitted, save_fitted
from millrace.operators.missing import FillNa


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([tuple(float(i * 10 + c) for c in range(1, 9)) for i in range(20)],
                                 ", ".join(f"c{i} double" for i in range(1, 9)))


def test_assembled_order(wide):
    columns = ["c8", "c1", "c7", "c2", "c6", "c3"]
    row = fe.assemble(wide, columns, "v", keep=False).first()
    assert list(row["v"]) == [8.0, 1.0, 7.0, 2.0, 6.0, 3.0]
    assert row.__fields__ == ["c4", "c5", "v"]


def test_missing_values_in_vectors(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    assert fe.assemble(df, ["a", "b"], "v", handle_invalid="skip").count() == 1
    with pytest.raises(Exception):
        fe.assemble(df, ["a", "b"], "v").collect()


@pytest.mark.parametrize("limit", [False, True])
def test_string_index_both_ways(spark, limit):
    data = [(v,) for v in ["b", "a", "b", "c", "a", "d", None, "b"]]
    df = spark.createDataFrame(data, "s string").repartition(3)
    want = {"b": 0.0, "a": 1.0, "c": 2.0, "d": 3.0}
    kept = {r["s"]: r["s_IDX"] for r in fe.string_index(df, "s", "keep", limit).collect()}
    assert kept == {**want, None: 4.0}
    skipped = fe.string_index(df, "s", "skip", limit).collect()
    assert len(skipped) == 7 and {r["s"]: r["s_IDX"] for r in skipped} == want
    with pytest.raises(Exception):
        fe.string_index(df, "s", "error", limit).collect()


def test_index_to_string_needs_an_indexer(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "s string")
    model = train(make_estimator("string_indexer", inputCol="s", outputCol="i"), df)
    back = fe.index_to_string(model.transform(df), "i", "t", model)
    assert back.where("s <> t").count() == 0
    with pytest.raises(ValueError, match="StringIndexer"):
        fe.index_to_string(df, "s", "t", PipelineModel([model]))


def test_names_of_scaled_columns(wide):
    assert fe.normalize(wide, ["c1", "c2"]).columns[-2:] == ["c1_c2_TMP", "c1_c2_TMP_N"]
    assert fe.max_abs_scale(wide, ["c1", "c2"]).columns[-1] == "c1_c2_TMP_MAS"
    assert fe.min_max_scale(wide, ["c1", "c2"]).columns[8:] == ["c1_c2_TMP_MMS"]
    assert fe.pca(wide, ["c1", "c2"], 1).columns[8:] == ["c1_c2_P"]
    with pytest.raises(ValueError):
        fe.pca(fe.assemble(wide, ["c1", "c2"], "v"), "v", 1)


def test_bucketize_and_binarize(wide):
    got = fe.bucketize(wide, ["c1"], "-INF, 11, 101, +INF").select("c1", "c1_B").collect()
    assert all(r["c1_B"] == (r["c1"] >= 11) + (r["c1"] >= 101) for r in got)
    closed = fe.bucketize(wide, ["c1"], [1, 11, 191]).agg(F.max("c1_B")).first()[0]
    assert closed == 1.0
    assert fe.binarize(wide, {"c1": 100, "c2": 2}).columns[-2:] == ["c1_B", "c2_B"]


def test_text_stages(spark):
    df = spark.createDataFrame([(0, "The cat  sat"), (1, "the dog"), (2, "")], "id int, t string")
    words = fe.tokenize(df, "t")
    assert [r["t__output"] for r in words.collect()] == [
        ["the", "cat", "", "sat"], ["the", "dog"], [""]]
    kept = fe.remove_stop_words(words, "t__output", "k", ["THE"])
    assert kept.first()["k"] == ["cat", "", "sat"]
    cased = fe.remove_stop_words(words, "t__output", "k", ["THE"], case_sensitive=True)
    assert cased.first()["k"][0] == "the"
    assert fe.hashing_tf(words, "t__output", "h", numFeatures=8, binary=True).first()["h"].size == 8


@pytest.mark.parametrize("few", [100_000, 0])
def test_vocabulary_matches_spark(spark, monkeypatch, few):
    monkeypatch.setattr("millrace.ml.vocabulary._FEW_WORDS", few)
    from pyspark.ml.feature import CountVectorizer
    texts = ["a b b c", "b c d d d", "c c e", "f a b", "d"]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)],
                               "id int, w array<string>").repartition(3)
    for params in ({"minDF": 2.0}, {"minDF": 0.5}, {"maxDF": 2.0}, {"maxDF": 0.4}, {"binary": True},
                   {"minTF": 2.0}, {"vocabSize": 3}):
        ours = fe.count_vectorize(df, "w", "v", params.get("vocabSize"), **{
            k: v for k, v in params.items() if k != "vocabSize"})
        model = CountVectorizer(inputCol="w", outputCol="v", **params).fit(df)
        # Equally frequent words may be ordered differently: compare the counts as bags.
        def bags(scored):
            return sorted((r["id"], sorted(r["a"])) for r in scored.select(
                "id", vector_to_array("v").alias("a")).collect())
        assert bags(ours) == bags(model.transform(df)), params
    with pytest.raises(ValueError, match="empty"):
        fe.count_vectorize(df, "w", "v", minDF=50.0)
    with pytest.raises(ValueError, match="takes"):
        fe.count_vectorize(df, "w", "v", least=1)


def test_parameters_by_name():
    tree = make_estimator("decision_tree_classifier", maxDepth="7", cacheNodeIds="true", seed="3",
                          minInfoGain="0.5", thresholds="0.2,0.8", weightCol="")
    assert tree.getMaxDepth() == 7 and tree.getCacheNodeIds() is True
    assert tree.getThresholds() == [0.2, 0.8] and tree.getMinInfoGain() == 0.5
    assert make_estimator("multilayer_perceptron", layers="4, 3,2").getLayers() == [4, 3, 2]
    for name, params in [("no_such_model", {}), ("kmeans", {"depth": 3}),
                         ("kmeans", {"k": "many"}), ("one_vs_rest", {}),
                         ("one_vs_rest", {"classifier": make_estimator("linear_regression")})]:
        with pytest.raises(ValueError):
            make_estimator(name, **params)


def test_grid_and_evaluators():
    lr = make_estimator("linear_regression")
    grid = param_grid(lr, [("regParam", ["0.1", 0.2]), ("fitIntercept", []), ("solver", ["normal"]),
                           ("maxIter", [])])
    assert len(grid) == 4
    assert {m[lr.regParam] for m in grid} == {0.1, 0.2}
    assert {m[lr.fitIntercept] for m in grid} == {True, False}
    assert make_evaluator("clustering", "features", "prediction").getFeaturesCol() == "features"
    assert make_evaluator("binary", "label", "raw").getRawPredictionCol() == "raw"
    for call in (lambda: make_evaluator("other", "a", "b"), lambda: param_grid(lr, {"depth": [1]}),
                 lambda: tune(lr, {}, "regression", "l", "p", method="guess")):
        with pytest.raises(ValueError):
            call()


def test_saved_stages(spark, wide, tmp_path):
    data = wide.withColumn("label", F.col("c1") * 2 + F.col("c2"))
    indexer = make_estimator("linear_regression", featuresCol="v")
    from pyspark.ml.feature import VectorAssembler
    stages = [FillNa(values={"c1": "0"}), VectorAssembler(inputCols=["c1", "c2"], outputCol="v")]
    model = train(Pipeline(stages=[*stages, indexer]), data)
    listed = fitted_stages(spark, model).orderBy("position").collect()
    assert [r["name"] for r in listed] == ["FillNa", "VectorAssembler", "LinearRegressionModel"]
    assert listed[1]["inputs"] == ["c1", "c2"]
    path = str(tmp_path / "m")
    save_fitted(model, path, uids=[listed[1]["uid"], listed[2]["uid"]])
    loaded = load_fitted(path)
    assert [type(s).__name__ for s in loaded.stages] == ["VectorAssembler", "LinearRegressionModel"]
    before = [r["prediction"] for r in score(model, data).collect()]
    assert [r["prediction"] for r in score(loaded, data).collect()] == before
    with pytest.raises(Exception):
        save_fitted(model, path)
    save_fitted(model.stages[0], path, overwrite=True)
    assert load_fitted(path).stages[0].getValues() == {"c1": "0"}
    with pytest.raises(ValueError, match="no such stage"):
        save_fitted(model, path, True, uids=["x"])
    with pytest.raises(ValueError, match="at least one"):
        save_fitted([], path, True)


def test_recorded_stages(spark, wide):
    from millrace.ml.stages import recording
    from millrace.operators.missing import fillna, impute
    words = spark.createDataFrame([("a b a", 1), ("b c", None)], "t string, i int")
    with recording() as stages:
        df = impute(fillna(words, {"t": ""}), ["i"])
        df = fe.count_vectorize(fe.tokenize(df, "t"), "t__output", "v")
    assert [type(s).__name__ for s in stages] == [
        "FillNa", "SQLTransformer", "ImputerModel", "Tokenizer", "WordTable"]
    again = PipelineModel(stages).transform(words).select(df.columns)
    assert again.orderBy("t").collect() == df.orderBy("t").collect()
    fe.tokenize(words, "t")
    assert len(stages) == 5


def test_distributed_index_is_saved(spark, tmp_path):
    from millrace.ml.stages import recording
    df = spark.createDataFrame([(v,) for v in "abacab"], "s string")
    with recording() as stages:
        indexed = fe.string_index(df, "s", "keep", distributed=True)
    assert [type(s).__name__ for s in stages] == ["LabelTable"]
    save_fitted(stages, str(tmp_path / "stages"))
    loaded = load_fitted(str(tmp_path / "stages"))
    more = spark.createDataFrame([(v,) for v in "abcx"], "s string")
    assert sorted(map(tuple, loaded.transform(more).collect())) == [
        ("a", 0.0), ("b", 1.0), ("c", 2.0), ("x", 3.0)]
    assert sorted(map(tuple, loaded.transform(df).collect())) == sorted(map(tuple, indexed.collect()))


def test_vocabulary_table_is_saved(spark, tmp_path):
    from millrace.ml.stages import recording
    rows = [(1, ["a", "b", "a", None]), (2, None), (3, []), (4, ["c"]), (4, ["c"]), (None, ["b", "x"])]
    df = spark.createDataFrame(rows, "id int, w array<string>").repartition(3)
    with recording() as stages:
        counted = fe.count_vectorize(df, "w", "v", 3)
    values = sorted((str(r["id"]), list(r["v"].toArray())) for r in counted.collect())
    # b and c are as frequent as a: ties go by the alphabet.
    assert values == [("1", [2, 1, 0]), ("2", [0, 0, 0]), ("3", [0, 0, 0]), ("4", [0, 0, 1]),
                      ("4", [0, 0, 1]), ("None", [0, 1, 0])]
    save_fitted(stages, str(tmp_path / "stages"))
    loaded = load_fitted(str(tmp_path / "stages")).transform(df)
    assert sorted((str(r["id"]), list(r["v"].toArray())) for r in loaded.collect()) == values
    more = spark.createDataFrame([(["z"],), (["a", "z"],)], "w array<string>")
    assert sorted(list(r["v"].toArray()) for r in stages[0].transform(more).collect()) == [
        [0, 0, 0], [1, 0, 0]]
    half = spark.createDataFrame([(["a", "b", "b"],)], "w array<string>")
    assert list(fe.count_vectorize(half, "w", "v", minTF=0.5).first()["v"].toArray()) == [2, 0]
    assert list(fe.count_vectorize(half, "w", "v", binary=True).first()["v"].toArray()) == [1, 1]


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "steps", "one"])
def test_isotonic_over_ranges(spark, kind):
    import random

    from pyspark.ml.regression import IsotonicRegression

    from millrace.ml.isotonic import fit_ranges, isotonic_fitted
    r = random.Random(4)
    make = {"noise": lambda i: i / 40 + r.gauss(0, 2), "falling": lambda i: -i, "rising": lambda i: i,
            "steps": lambda i: (i // 30) % 4 + r.random(), "one": lambda i: 3.0}[kind]
    rows_ = [(float(i % (1 if kind == "one" else 300)), float(make(i % 300)), 1.0 + i % 3)
             for i in range(600)]
    df = spark.createDataFrame(rows_ + [(None, 1.0, 1.0), (1.0, None, 1.0), (2.0, 5.0, 0.0)],
                               "x double, y double, w double").repartition(3)
    for rising in (True, False):
        model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=rising).fit(
            df.dropna().where("w > 0"))
        want = {r["x"]: r["prediction"] for r in model.transform(df.dropna()).collect()}
        got = isotonic_fitted(df, "x", "y", weight="w", rising=rising).collect()
        assert len(got) == len(rows_) + 3 and [r["fitted"] for r in got if r["x"] is None] == [None]
        for r in got:
            if r["x"] is not None:
                known = {x for x, _, _ in rows_}  # other features have no fitted value
                expected = pytest.approx(want[r["x"]], abs=1e-9) if r["x"] in known else None
                assert r["fitted"] == expected
    fit = fit_ranges(df, "x", "y", "w")
    blocks = sorted(map(tuple, fit.blocks.collect()))
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(blocks, blocks[1:]))
    assert sum(b[3] for b in blocks) == pytest.approx(sum(r[2] for r in rows_))
    assert fit_ranges(df.limit(0), "x", "y").points.count() == 0


def test_junctions_read_no_further_than_they_pool():
    from millrace.ml.isotonic import Block, junction, pool
    import random
    r = random.Random(1)
    for _ in range(200):
        points = [Block(i, i, float(r.randrange(10)), 1.0 + r.randrange(3)) for i in range(20)]
        cut = r.randrange(1, 20)
        left, right = ([b for b, _ in pool(p)] for p in (points[:cut], points[cut:]))
        ends = [iter(left[::-1]), iter(right)]
        found = junction(*ends)
        kept = [b for b in left + right if found is None or b.high < found.low or b.low > found.high]
        whole = sorted(kept + ([found] if found else []))
        assert [(b.low, b.high) for b in whole] == [(b.low, b.high) for b, _ in pool(points)]


def test_pool_sums_sparse_vectors(spark):
    """Rows with the same most frequent slot become one; rows without a value are in none."""
    rows = [(1, Vectors.sparse(9, [1, 4], [2.0, 5.0])), (2, Vectors.sparse(9, [4, 8], [3.0, 3.0])),
            (3, Vectors.sparse(9, [0, 7], [1.0, 2.0])), (4, Vectors.sparse(9, [], []))]
    df = spark.createDataFrame(rows, ["id", "v"]).repartition(3)
    pooled = {r["pool"]: r["v"] for r in fe.pool(df, "v", fe.top_slot("v")).collect()}
    assert pooled == {4: Vectors.sparse(9, [1, 4, 8], [2.0, 8.0, 3.0]),
                      7: Vectors.sparse(9, [0, 7], [1.0, 2.0])}


def test_a_large_pool_is_dealt_to_several(spark, monkeypatch):
    rows = [(i, i % 2, Vectors.sparse(50, [0, 1 + i % 2, 3 + i], [5.0, 2.0, 1.0])) for i in range(40)]
    df = spark.createDataFrame(rows + [(99, 7, Vectors.sparse(50, [2], [1.0]))], ["id", "p", "v"]).repartition(3)
    monkeypatch.setattr(fe, "_POOLED", 20)
    pooled = fe.pool(df, "v", F.col("p")).collect()
    assert [r["v"] for r in pooled if r["pool"] == 7] == [Vectors.sparse(50, [2], [1.0])]
    for p in (0, 1):
        parts = [r["v"].toArray() for r in pooled if r["pool"] == p]
        assert 2 <= len(parts) <= 3 and all(x[0] > 0 for x in parts)
        assert sum(parts).tolist() == sum(v.toArray() for _, q, v in rows if q == p).tolist()


def test_giant_vectors_are_read_by_themselves(spark):
    from pyarrow import parquet
    from millrace.ml.vocabulary import sparse_vectors
    many = F.sequence(F.lit(0), F.lit(1_499_999))
    df = spark.range(3, numPartitions=1).select("id", many.alias("i"), F.transform(
        many, lambda i: F.xxhash64(i, "id").cast("double")).alias("x"))
    found = sparse_vectors(df, "id", F.lit(1_500_000), F.col("i"), F.col("x"), "v", giant=True)
    files = [parquet.ParquetFile(f.removeprefix("file:")) for f in found.inputFiles()]
    assert [f.metadata.num_row_groups for f in files] == [3]
