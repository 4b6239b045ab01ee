"""Missing values: fill, drop, impute."""

from __future__ import annotations

from decimal import Decimal

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import Imputer, SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.ml.stages import record
from millrace.operators.stats import quantiles
from millrace.util import check_columns, col, names, pairs, quoted, require

_FLOATING = (T.FloatType, T.DoubleType)


def _constant(name: str, kind: T.DataType, value):
    """The replacement as a Python value of the column's type."""
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else {"true": True, "false": False}[value.lower()]
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int(value)
    if isinstance(kind, _FLOATING):
        return float(value)
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    raise ValueError(f"column {name}: cannot fill type {kind.simpleString()}; use boolean, int, "
                     "long, float, double, string or decimal")


def fillna(df: DataFrame, values) -> DataFrame:
    """Replace NULL, and NaN in floating columns, by a constant per column.

    Names that the input lacks are ignored.
    """
    return record(FillNa(values=values)).transform(df)


def _filled(df: DataFrame, wanted: dict) -> DataFrame:
    out = []
    for field in df.schema:
        source = col(field.name)
        if field.name in wanted:
            value = F.lit(_constant(field.name, field.dataType, wanted[field.name]))
            if isinstance(field.dataType, _FLOATING):
                source = F.nanvl(source, F.lit(None).cast(field.dataType))
            source = F.coalesce(source, value.cast(field.dataType)).alias(field.name)
        out.append(source)
    return df.select(out)


class FillNa(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``fillna`` as a pipeline stage that can be saved and loaded."""

    values = Param(Params._dummy(), "values", "replacement per column", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, values=None):
        super().__init__()
        if values is not None:
            self._set(values=dict(pairs(values)))

    def setValues(self, values):
        return self._set(values=dict(pairs(values)))

    def getValues(self):
        return self.getOrDefault(self.values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _filled(dataset, self.getValues())


def dropna(df: DataFrame, columns, how="any") -> DataFrame:
    """Drop rows with missing values in the listed columns.

    ``how`` is ``any``, ``all`` or a number n: a row goes when n or more of
    the columns are missing. NaN counts as missing in floating columns.
    """
    columns = names(columns)
    check_columns(df, columns)
    subset = [quoted(c) for c in columns]
    if how in ("any", "all"):
        return df.na.drop(how=how, subset=subset)
    try:
        n = int(how)
    except ValueError:
        raise ValueError(f"how must be any, all or a number, not {how}") from None
    return df.na.drop(thresh=len(columns) + 1 - n, subset=subset)


def impute(df: DataFrame, columns, strategy: str = "mean") -> DataFrame:
    """Add ``{column}_I`` with missing values replaced by the mean or the exact (lower) median.

    Whole numbers are widened to double, so that the mean is not cut off.
    """
    columns = names(columns)
    check_columns(df, columns)
    require(strategy in ("mean", "median"), f"unknown strategy: {strategy}")
    whole = {c: f"_impute{i}" for i, c in enumerate(columns)
             if not isinstance(df.schema[c].dataType, _FLOATING)}
    widened = df
    if whole:
        casts = ", ".join(f"CAST({quoted(c)} AS DOUBLE) AS {name}" for c, name in whole.items())
        widened = record(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__")).transform(df)
    sources = {c: whole.get(c, c) for c in columns}
    if strategy == "median":
        return _with_medians(widened, sources).drop(*whole.values())
    imputer = Imputer(strategy=strategy, inputCols=list(sources.values()),
                      outputCols=[f"{c}_I" for c in columns])
    return record(imputer.fit(widened)).transform(widened).drop(*whole.values())


def _with_medians(df: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Exact medians: Spark's own stage takes any value within a thousandth of the ranks."""
    medians = quantiles(df, list(sources.values()), [0.5]).first()
    filled = []
    for name, source in sources.items():
        kind, median = df.schema[source].dataType.simpleString(), medians[source]
        require(median is not None, f"column {name} has no values to take a median of")
        value = quoted(source)
        filled.append(f"CASE WHEN {value} IS NULL OR isnan({value}) "
                      f"THEN CAST('{median!r}' AS {kind}) ELSE {value} END AS {quoted(name + '_I')}")
    statement = f"SELECT *, {', '.join(filled)} FROM __THIS__"
    return record(SQLTransformer(statement=statement)).transform(df)
