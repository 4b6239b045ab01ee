"""A string index whose labels stay a table, as a stage that can be saved."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import row_index
from millrace.util import col, fresh, require, written

LABELS = "label string, idx bigint"


class LabelTable(Transformer, HasInputCol, HasOutputCol, HasHandleInvalid, MLReadable, MLWritable):
    """Joins each value with its index. ``size`` is the number of labels."""

    size = Param(Params._dummy(), "size", "number of labels", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, handleInvalid=None, size=None):
        super().__init__()
        self._setDefault(handleInvalid="error")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.labels: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require(self.labels is not None, "the stage has no labels")
        label, index = fresh(dataset, "_label"), fresh(dataset, "_idx")
        value = col(self.getInputCol()).cast("string")
        # A frequent value fills its side of the join, which adaptive execution splits; without
        # a value a row has no key at all and stays where it is.
        table = self.labels.toDF(label, index)
        joined = dataset.join(table, value == F.col(label), "left")
        found = F.col(index)
        if self.getHandleInvalid() == "skip":
            joined = joined.where(found.isNotNull())
        elif self.getHandleInvalid() == "keep":
            found = F.coalesce(found, F.lit(self.getOrDefault(self.size)))
        else:
            found = F.coalesce(found, F.raise_error(F.lit(
                f"{self.getInputCol()} has a NULL or unknown label")).cast("bigint"))
        return joined.withColumn(self.getOutputCol(), found.cast("double")).drop(label, index)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: LabelTable):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.labels.write.parquet(f"{path}/labels")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> LabelTable:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.labels = self.sparkSession.read.schema(LABELS).parquet(f"{path}/labels")
        return stage


def fit_label_table(df: DataFrame, column: str, out: str, handle_invalid: str) -> LabelTable:
    """Rank the values of a column by frequency, then by the alphabet."""
    value = col(column).cast("string")
    counts = (df.where(value.isNotNull()).groupBy(value.alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))
    ranked = row_index(counts, [("n", "desc"), "label"], "idx").select(
        "label", F.col("idx").cast("bigint").alias("idx"))
    stage = LabelTable(inputCol=column, outputCol=out, handleInvalid=handle_invalid)
    stage.labels = written(ranked, "labels")
    return stage._set(size=stage.labels.count())
