"""Saving, loading and listing fitted stages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from millrace.util import require


def _stages(model) -> list:
    if isinstance(model, (list, tuple)):
        return [s for m in model for s in _stages(m)]
    return list(model.stages) if isinstance(model, PipelineModel) else [model]


def _inputs(stage) -> list[str]:
    for name in ("inputCols", "inputCol", "featuresCol", "itemsCol", "userCol"):
        if stage.hasParam(name) and stage.isDefined(name):
            value = stage.getOrDefault(name)
            return list(value) if isinstance(value, (list, tuple)) else [value]
    return []


def fitted_stages(spark: SparkSession, model) -> DataFrame:
    """One row per fitted stage: ``position``, ``name``, ``uid`` and ``inputs``."""
    rows = [(i, type(s).__name__, s.uid, _inputs(s)) for i, s in enumerate(_stages(model))]
    return spark.createDataFrame(rows, "position int, name string, uid string, inputs array<string>")


def save_fitted(model, path: str, overwrite: bool = False, uids=None) -> None:
    """Save a fitted stage, or several as one pipeline.

    ``uids`` chooses stages of the model; an unknown one is an error.
    """
    stages = _stages(model)
    if uids is not None:
        known = {s.uid: s for s in stages}
        missing = [u for u in uids if u not in known]
        require(not missing, f"no such stage: {', '.join(missing)}")
        stages = [s for s in stages if s.uid in set(uids)]
    require(bool(stages), "choose at least one stage to save")
    writer = PipelineModel(stages).write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_fitted(path: str) -> PipelineModel:
    """What ``save_fitted`` saved, as a pipeline."""
    return PipelineModel.load(path)
