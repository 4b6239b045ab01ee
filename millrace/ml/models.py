"""Training, scoring and tuning of Spark ML models."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, classification, clustering, evaluation, fpm
from pyspark.ml import feature, recommendation, regression, tuning
from pyspark.ml.classification import Classifier, OneVsRest
from pyspark.sql import DataFrame

from millrace.ml.stages import _typed, configure, numbers
from millrace.ml.topics import TopicLDA
from millrace.util import pairs, require

ESTIMATORS = {
    "logistic_regression": classification.LogisticRegression,
    "decision_tree_classifier": classification.DecisionTreeClassifier,
    "random_forest_classifier": classification.RandomForestClassifier,
    "gbt_classifier": classification.GBTClassifier,
    "multilayer_perceptron": classification.MultilayerPerceptronClassifier,
    "linear_svc": classification.LinearSVC,
    "naive_bayes": classification.NaiveBayes,
    "one_vs_rest": classification.OneVsRest,
    "linear_regression": regression.LinearRegression,
    "generalized_linear_regression": regression.GeneralizedLinearRegression,
    "decision_tree_regressor": regression.DecisionTreeRegressor,
    "random_forest_regressor": regression.RandomForestRegressor,
    "gbt_regressor": regression.GBTRegressor,
    "aft_survival_regression": regression.AFTSurvivalRegression,
    "isotonic_regression": regression.IsotonicRegression,
    "kmeans": clustering.KMeans,
    "lda": TopicLDA,
    "bisecting_kmeans": clustering.BisectingKMeans,
    "gaussian_mixture": clustering.GaussianMixture,
    "fp_growth": fpm.FPGrowth,
    "als": recommendation.ALS,
    "string_indexer": feature.StringIndexer,
}


def make_estimator(name: str, **params) -> Estimator:
    """An unfitted estimator by name, with Spark ML parameters by name.

    ``thresholds`` and ``layers`` may be comma-separated text. ``classifier``
    is the estimator that ``one_vs_rest`` repeats.
    """
    require(name in ESTIMATORS, f"unknown estimator: {name}")
    estimator = ESTIMATORS[name]()
    if name == "one_vs_rest":
        base = params.get("classifier")
        require(isinstance(base, Classifier),
                f"one_vs_rest needs a classifier, not {type(base).__name__}")
    if params.get("thresholds"):
        params["thresholds"] = numbers(params["thresholds"])
    if params.get("layers"):
        params["layers"] = [int(n) for n in numbers(params["layers"])]
    # Empty text stands for a parameter that was not filled in.
    return configure(estimator, **{k: None if v == "" else v for k, v in params.items()})


# Ratings that a block of ALS holds; a task holds one block.
_BLOCK = 1 << 21


def train(estimator: Estimator, df: DataFrame) -> Model:
    """The fitted model. ALS gets so many blocks that each is of a bounded size, where the caller has
    not said how many; the rows are counted first."""
    if isinstance(estimator, recommendation.ALS):
        sides = [p for p in (estimator.numUserBlocks, estimator.numItemBlocks) if not estimator.isSet(p)]
        blocks = -(-df.count() // _BLOCK) if sides else 0
        estimator = estimator.copy({p: max(estimator.getOrDefault(p), blocks) for p in sides})
    return estimator.fit(df)


def score(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def make_evaluator(kind: str, label: str, prediction: str):
    """The measure that tuning optimises.

    For ``clustering`` the label is the features column, for ``binary`` the
    prediction is the raw prediction.
    """
    makers = {
        "regression": lambda: evaluation.RegressionEvaluator(
            labelCol=label, predictionCol=prediction),
        "clustering": lambda: evaluation.ClusteringEvaluator(
            featuresCol=label, predictionCol=prediction),
        "binary": lambda: evaluation.BinaryClassificationEvaluator(
            labelCol=label, rawPredictionCol=prediction),
        "multiclass": lambda: evaluation.MulticlassClassificationEvaluator(
            labelCol=label, predictionCol=prediction),
    }
    require(kind in makers, f"unknown evaluator: {kind}")
    return makers[kind]()


def param_grid(estimator: Estimator, grid) -> list:
    """All combinations of the listed values; a boolean parameter tries both values."""
    builder = tuning.ParamGridBuilder()
    for name, values in pairs(grid):
        require(estimator.hasParam(name), f"{type(estimator).__name__} has no parameter {name}")
        param = estimator.getParam(name)
        default = estimator.getOrDefault(param) if estimator.isDefined(param) else None
        if isinstance(default, bool):
            builder.addGrid(param, [False, True])
        elif values:
            builder.addGrid(param, [_typed(name, v, default) if isinstance(v, str) else v
                                    for v in values])
    return builder.build()


def tune(estimator: Estimator, grid, evaluator: str, label: str, prediction: str,
         method: str = "cross_validation", **params) -> Estimator:
    """An estimator that tries the grid and keeps the best model.

    ``method`` is ``cross_validation`` (``numFolds``) or ``train_validation_split``
    (``trainRatio``); both take ``seed`` and ``parallelism``.
    """
    methods = {"cross_validation": tuning.CrossValidator,
               "train_validation_split": tuning.TrainValidationSplit}
    require(method in methods, f"unknown method: {method}")
    tuner = methods[method](estimator=estimator,
                            estimatorParamMaps=param_grid(estimator, grid),
                            evaluator=make_evaluator(evaluator, label, prediction))
    return configure(tuner, **params)
