"""Vector and similarity functions as native column expressions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.util import check_columns, col, fresh, is_vector, names, require

# The cut points between the similarity buckets 1 to 45.
SIMILARITY_CUTS = [
    -1.0, -0.377943, -0.230679, -0.18722, -0.158234, -0.135861, -0.11715, -0.100871, -0.0863382,
    -0.07305129, -0.0607377, -0.049179702, -0.038246108, -0.0278298, -0.0178302, -0.00817345,
    0.00051, 0.00970741, 0.0186835, 0.0275652, 0.0363054, 0.0449607, 0.0535734, 0.0621456,
    0.07072152, 0.0793494, 0.0880595, 0.0968779, 0.105835, 0.114963, 0.124312, 0.133941,
    0.143869, 0.154199, 0.165004, 0.176447, 0.188607, 0.201776, 0.216213, 0.232308, 0.250823,
    0.273066, 0.301835, 0.345467,
]


def _column(c) -> Column:
    return c if isinstance(c, Column) else col(c)


def _sum_of_products(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dot(a, b, null_value: float | None = None) -> Column:
    """Dot product of two arrays; NULL inputs give ``null_value``.

    Convert vector columns with ``vector_to_array`` first. Different lengths
    raise an error.
    """
    a, b = _column(a), _column(b)
    product = F.when(F.size(a) == F.size(b), _sum_of_products(a, b)).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return F.when(a.isNull() | b.isNull(), F.lit(null_value).cast("double")).otherwise(product)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def csv_dot(a, b) -> Column:
    """Dot product of two comma-separated lists; -1.0 if the lengths differ."""
    lists = [F.split(_column(c), ",").alias(name) for c, name in ((a, "a"), (b, "b"))]

    def product(parts):
        numbers = F.zip_with(parts["a"], parts["b"],
                             lambda x, y: F.trim(x).cast("double") * F.trim(y).cast("double"))
        total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)
        return (F.when(parts["a"].isNull() | parts["b"].isNull(), F.lit(None).cast("double"))
                .when(F.size(parts["a"]) == F.size(parts["b"]), total).otherwise(F.lit(-1.0)))
    return _once(F.struct(*lists), product)


def similarity_bucket(a, b) -> Column:
    """Bucket 1 … 45 of the dot product of two comma-separated lists; NULL for NULL."""
    cuts = F.array(*[F.lit(c) for c in SIMILARITY_CUTS])

    def bucket(similarity):
        reached = F.size(F.filter(cuts, lambda cut: cut <= similarity))
        return F.when(similarity.isNotNull(), (reached + 1).cast("bigint"))
    return _once(csv_dot(a, b), bucket)


def normalized(vector) -> Column:
    """An array scaled to length 1; a zero vector stays as it is."""
    def scaled(v):
        length = F.sqrt(F.aggregate(v["v"], F.lit(0.0), lambda total, x: total + x * x))
        return _once(F.struct(v["v"].alias("v"), length.alias("n")), lambda w: F.when(
            w["n"] > 0, F.transform(w["v"], lambda x: x / w["n"])).otherwise(w["v"]))
    return _once(F.struct(_column(vector).alias("v")), scaled)


def sum_normalize(vectors) -> Column:
    """The normalised sum of an array of equally long arrays."""
    vectors = F.transform(_column(vectors), lambda v: v.cast("array<double>"))
    total = F.aggregate(F.slice(vectors, 2, F.size(vectors)), F.get(vectors, F.lit(0)),
                        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return normalized(total)


def normalized_sums(df: DataFrame, keys, vector: str, out: str) -> DataFrame:
    """The normalised sum of a vector or array column per group.

    Sums are merged on the map side; no group is collected.
    """
    keys = names(keys)
    check_columns(df, [*keys, vector])
    require(out not in keys, "the output must not be a key")
    source = col(vector) if is_vector(df, vector) else array_to_vector(
        col(vector).cast("array<double>"))
    total = fresh(df, "_total")
    sums = df.groupBy(*[col(k) for k in keys]).agg(Summarizer.sum(source).alias(total))
    return sums.select(*[col(k) for k in keys], normalized(vector_to_array(total)).alias(out))
