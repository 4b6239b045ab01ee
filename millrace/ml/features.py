"""Feature engineering with Spark ML: every operator fits, where needed, and transforms.

Several columns share one stage and one fit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml import feature as mlf
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.ml.labels import fit_label_table
from millrace.ml.stages import configure, record
from millrace.ml.vocabulary import fit_and_count, sparse_vectors
from millrace.ml.wordvectors import fit_word_vectors
from millrace.util import check_columns, col, names, pairs, require, written


def fit(df: DataFrame, stage):
    """The fitted stage; a plain transformer is returned as it is."""
    return stage.fit(df) if isinstance(stage, Estimator) else stage


def apply(df: DataFrame, stage) -> DataFrame:
    """Fit the stage if it must be fitted, note it for saving, and transform."""
    return record(fit(df, stage)).transform(df)


# --- Categories -------------------------------------------------------------

def string_index(df: DataFrame, columns, handle_invalid: str = "error",
                 distributed: bool = False) -> DataFrame:
    """Add ``{column}_IDX``: the rank of the value by frequency, from 0.

    Ties go by the alphabet. NULL, and at scoring an unknown value, raises, is
    skipped or gets the next free index (``handle_invalid`` is error, skip or
    keep). A plain stage holds all labels on the driver and in every task; with
    ``distributed`` they stay a table, joined to the rows, for columns with very
    many values. Both are stages that can be saved.
    """
    columns = names(columns)
    check_columns(df, columns)
    require(handle_invalid in ("error", "skip", "keep"), f"unknown choice: {handle_invalid}")
    if not distributed:
        return apply(df, mlf.StringIndexer(
            inputCols=columns, outputCols=[f"{c}_IDX" for c in columns],
            handleInvalid=handle_invalid))
    for column in columns:
        df = record(fit_label_table(df, column, f"{column}_IDX", handle_invalid)).transform(df)
    return df


def index_to_string(df: DataFrame, column: str, out: str, model) -> DataFrame:
    """Map indices back to the labels of a fitted string indexer."""
    require(isinstance(model, StringIndexerModel), "a fitted StringIndexer is needed, not "
            f"{type(model).__name__}")
    return apply(df, mlf.IndexToString(inputCol=column, outputCol=out, labels=model.labels))


def one_hot(df: DataFrame, columns, drop_last: bool = True,
            handle_invalid: str = "error") -> DataFrame:
    """Add the indicator vector ``{column}_E`` of each index column."""
    columns = names(columns)
    return apply(df, mlf.OneHotEncoder(
        inputCols=columns, outputCols=[f"{c}_E" for c in columns], dropLast=drop_last,
        handleInvalid=handle_invalid))


def feature_hash(df: DataFrame, columns, out: str, categorical=(), **params) -> DataFrame:
    """Hash numbers and categories into one sparse vector."""
    stage = mlf.FeatureHasher(inputCols=names(columns), outputCol=out)
    if categorical:
        stage.setCategoricalCols(names(categorical))
    return apply(df, configure(stage, **params))


# --- Vectors ----------------------------------------------------------------

def assemble(df: DataFrame, columns, out: str, keep: bool = True,
             handle_invalid: str = "error") -> DataFrame:
    """Put columns, in the listed order, into one vector."""
    columns = names(columns)
    assembled = apply(df, mlf.VectorAssembler(inputCols=columns, outputCol=out,
                                              handleInvalid=handle_invalid))
    return assembled if keep else assembled.drop(*[c for c in columns if c != out])


def _scaled(df: DataFrame, columns, out: str | None, suffix: str, stage, keep_vector: bool):
    """Apply a one-vector stage to a vector column, or to several plain columns.

    A single name is a vector column and needs ``out``. A list is assembled to
    ``a_b_TMP`` and the output named after it.
    """
    if isinstance(columns, str):
        require(out is not None, "an output column is needed")
        return apply(df, stage.setInputCol(columns).setOutputCol(out))
    vector = "_".join(names(columns)) + "_TMP"
    result = apply(assemble(df, columns, vector),
                   stage.setInputCol(vector).setOutputCol(out or suffix.format(
                       vector=vector, stem="_".join(columns))))
    return result if keep_vector else result.drop(vector)


def normalize(df: DataFrame, columns, out: str | None = None, p=2.0) -> DataFrame:
    """Scale each row's vector to length 1 in the p-norm.

    A list of columns gives ``a_b_TMP`` and ``a_b_TMP_N``. A ``p`` that is no
    number means the maximum norm.
    """
    try:
        p = float(p)
    except (TypeError, ValueError):
        p = float("inf")
    return _scaled(df, columns, out, "{vector}_N", mlf.Normalizer(p=p), keep_vector=True)


def max_abs_scale(df: DataFrame, columns, out: str | None = None) -> DataFrame:
    """Divide each element by its largest absolute value; lists give ``a_b_TMP_MAS``."""
    return _scaled(df, columns, out, "{vector}_MAS", mlf.MaxAbsScaler(), keep_vector=False)


def min_max_scale(df: DataFrame, columns, out: str | None = None, min: float = 0.0,
                  max: float = 1.0) -> DataFrame:
    """Move each element to the range [min, max]; lists give ``a_b_TMP_MMS``."""
    return _scaled(df, columns, out, "{vector}_MMS", mlf.MinMaxScaler(min=min, max=max),
                   keep_vector=False)


def pca(df: DataFrame, columns, k: int, out: str | None = None) -> DataFrame:
    """Project on the first k principal components; lists give ``a_b_P``."""
    return _scaled(df, columns, out, "{stem}_P", mlf.PCA(k=k), keep_vector=False)


def standard_scale(df: DataFrame, column: str, out: str, **params) -> DataFrame:
    """Divide by the standard deviation (``withStd``), after centring (``withMean``)."""
    return apply(df, configure(mlf.StandardScaler(inputCol=column, outputCol=out), **params))


def vector_index(df: DataFrame, column: str, out: str, **params) -> DataFrame:
    """Index the categorical slots of a vector (at most ``maxCategories`` values)."""
    return apply(df, configure(mlf.VectorIndexer(inputCol=column, outputCol=out), **params))


def vector_slice(df: DataFrame, column: str, out: str, indices=(), slots=()) -> DataFrame:
    """Keep some elements of a vector, by position and by slot name."""
    require(len(indices) + len(slots) > 0, "at least one element is needed")
    return apply(df, mlf.VectorSlicer(inputCol=column, outputCol=out, indices=list(indices),
                                      names=list(slots)))


# Ways to select: how many features, what share of them, or the highest p-value, as it is or
# corrected for the number of features in two ways.
SELECTION_MODES = {"top": "numTopFeatures", "percentile": "percentile", "fpr": "fpr", "fdr": "fdr",
                   "fwe": "fwe"}


def chisq_select(df: DataFrame, features: str, label: str, out: str, mode: str = "top",
                 threshold: float = 50) -> DataFrame:
    """Keep the categorical features that depend on a categorical label, by ``SELECTION_MODES``."""
    require(mode in SELECTION_MODES, f"unknown way to select: {mode}")
    stage = mlf.UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol=out,
                                          selectionMode=SELECTION_MODES[mode])
    stage.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(threshold)
    return apply(df, stage)


# --- Numbers ----------------------------------------------------------------

def binarize(df: DataFrame, thresholds) -> DataFrame:
    """Add ``{column}_B``: 1.0 above the column's threshold, else 0.0."""
    listed = pairs(thresholds)
    require(bool(listed), "at least one column is needed")
    return apply(df, mlf.Binarizer(inputCols=[c for c, _ in listed],
                                   outputCols=[f"{c}_B" for c, _ in listed],
                                   thresholds=[float(t) for _, t in listed]))


# How open ends of a list of splits are written.
OPEN_ENDS = {"-INF": float("-inf"), "+INF": float("inf")}


def bucketize(df: DataFrame, columns, splits, handle_invalid: str = "error") -> DataFrame:
    """Add ``{column}_B``: the number of the bucket; the last bucket is closed."""
    columns = names(columns)
    if isinstance(splits, str):
        splits = [s.strip() for s in splits.split(",") if s.strip()]
    edges = [OPEN_ENDS[s] if s in OPEN_ENDS else float(s) for s in splits]
    return apply(df, mlf.Bucketizer(inputCols=columns, outputCols=[f"{c}_B" for c in columns],
                                    splitsArray=[edges] * len(columns),
                                    handleInvalid=handle_invalid))


# --- Text -------------------------------------------------------------------

def tokenize(df: DataFrame, columns) -> DataFrame:
    """Add ``{column}__output``: lower-case words, split at white space."""
    for column in names(columns):
        df = apply(df, mlf.Tokenizer(inputCol=column, outputCol=f"{column}__output"))
    return df


def remove_stop_words(df: DataFrame, column: str, out: str, stop_words,
                      case_sensitive: bool = False) -> DataFrame:
    """Drop the listed words from a word list."""
    return apply(df, mlf.StopWordsRemover(inputCol=column, outputCol=out,
                                          stopWords=list(stop_words),
                                          caseSensitive=case_sensitive))


def hashing_tf(df: DataFrame, column: str, out: str, **params) -> DataFrame:
    """Term counts, with words hashed to ``numFeatures`` slots."""
    return apply(df, configure(mlf.HashingTF(inputCol=column, outputCol=out), **params))


def count_vectorize(df: DataFrame, column: str, out: str, vocab_size: int | None = None,
                    **params) -> DataFrame:
    """Term counts over all words, or the ``vocab_size`` most frequent ones (``minDF``, ``maxDF``,
    ``minTF``, ``binary``).

    The vocabulary is a table; words are joined with it, so its size is not bounded by
    the driver. Ties in frequency go by the alphabet.
    """
    known = ("minDF", "maxDF", "minTF", "binary")
    require(set(params) <= set(known),
            f"count_vectorize takes {', '.join(known)}, not {', '.join(params)}")
    check_columns(df, [column])
    stage, counted = fit_and_count(df, column, out, vocab_size, **params)
    record(stage)
    return counted


def top_slot(column: str) -> Column:
    """The slot of a sparse vector with the largest value, the first of several; NULL without any."""
    parts = F.unwrap_udt(col(column))
    values = parts["values"]
    return F.get(parts["indices"], F.array_position(values, F.array_max(values)).cast("int") - 1)


# Values that the rows of a pool hold together.
_POOLED = 1 << 21


def pool(df: DataFrame, column: str, by: Column) -> DataFrame:
    """(pool, ``column``): the sums of the sparse vectors of all rows with the same pool.

    Rows whose pool is NULL are left out. A pool whose rows hold more than ``_POOLED`` values together is
    dealt to several, by hashes of its rows. Slots are summed and sorted before a pool is gathered, so
    that what a task holds of one is a number and a value for each slot that it has.
    """
    def gathered(batches):
        pool, parts = None, []

        def row():
            i, x = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("i", "x"))
            ends = pa.array([0, len(i)], pa.int32())
            return pa.RecordBatch.from_arrays([parts[0].column(c).slice(0, 1) for c in ("pool", "size")] + [
                pa.ListArray.from_arrays(ends, i), pa.ListArray.from_arrays(ends, x)],
                names=["pool", "size", "i", "x"])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("pool", "size", "part"))))
            edges = [n for n, key in enumerate(keys) if not n or key != keys[n - 1]] + [len(keys)]
            for a, b in zip(edges, edges[1:]):
                if parts and keys[a] != pool:
                    yield row()
                    parts = []
                pool = keys[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield row()
    check_columns(df, [column])
    parts = F.unwrap_udt(col(column))
    rows = df.select(by.alias("pool"), parts["size"].alias("size"), parts["indices"].alias("i"),
                     parts["values"].alias("x")).where("pool is not null")
    giant = rows.groupBy("pool").agg(F.sum(F.size("i")).alias("n")).where(F.col("n") > _POOLED).select(
        "pool", F.ceil(F.col("n") / _POOLED).alias("many"))  # few: each has so many values
    part = F.pmod(F.xxhash64("i", "x"), F.coalesce("many", F.lit(1))).alias("part")
    slots = rows.join(F.broadcast(giant), "pool", "left").select(
        "pool", "size", part, F.explode(F.arrays_zip("i", "x")).alias("slot"))
    sums = slots.groupBy("pool", "size", "part", F.col("slot.i").alias("i")).agg(F.sum("slot.x").alias("x"))
    schema = T.StructType([sums.schema["pool"], sums.schema["size"]]).add(
        "i", T.ArrayType(T.IntegerType())).add("x", T.ArrayType(T.DoubleType()))
    key = ["pool", "size", "part"]
    rows = sums.repartition(*key).sortWithinPartitions(*key, "i").mapInArrow(gathered, schema)
    return sparse_vectors(rows, "pool", F.col("size"), F.col("i"), F.col("x"), column, giant=True)


def word2vec(df: DataFrame, column: str, out: str, **params) -> DataFrame:
    """The average word vector of each word list (``vectorSize``, ``minCount``, ``maxIter``, ``seed``,
    ``numPartitions``, ``windowSize``, ``stepSize``, ``maxSentenceLength``, as Spark names them).

    The vectors are a table that is joined; neither the driver nor a task holds the vocabulary.
    """
    known = ("vectorSize", "minCount", "maxIter", "seed", "numPartitions", "windowSize", "stepSize",
             "maxSentenceLength")
    require(set(params) <= set(known),
            f"word2vec takes {', '.join(known)}, not {', '.join(params)}")
    check_columns(df, [column])
    return record(fit_word_vectors(df, column, out, **{
        k: v for k, v in params.items() if v is not None})).transform(df)
