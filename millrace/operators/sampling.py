"""Sampling and splitting.

Draws by ``rand`` depend on how the input is partitioned. Where a ``key`` is
given, a row is chosen by a hash of its key instead: the choice is then the
same for any partitioning and on every attempt of a task. Each operator draws
its own numbers, so that operators in a row with one seed stay independent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.util import check_columns, col, fresh, names, pairs, require

_STEPS = 1 << 52


def _draw(key, seed: int, operator: str) -> Column:
    """A number in [0, 1): random, or fixed by the key for this operator."""
    if key is None:
        return F.rand(seed)
    hashed = F.xxhash64(F.lit(operator), *[col(c) for c in names(key)], F.lit(seed))
    return F.pmod(hashed, F.lit(_STEPS)) / F.lit(float(_STEPS))


def sample(df: DataFrame, fraction: float, seed: int, with_replacement: bool = False,
           key=None) -> DataFrame:
    """A random fraction of the rows; with replacement, so many copies of each on average."""
    if key is None:
        return df.sample(with_replacement, fraction, seed)
    if with_replacement:
        return _drawn_often(df, fraction, seed, key)
    require(0.0 <= fraction <= 1.0, "the fraction must be between 0 and 1")
    return df.where(_draw(key, seed, "sample") < F.lit(float(fraction)))


_MOST_COPIES = 500.0  # beyond, the chance of no copy is too small for a number


def poisson_steps(mean: float) -> list[float]:
    """The chances of at most 0, 1, 2 … copies, as far as draws can tell them from certainty."""
    chance = total = math.exp(-mean)
    steps = []
    while total < 1.0 - 1.0 / _STEPS and len(steps) < 4 * mean + 60:
        steps.append(total)
        chance *= mean / len(steps)
        total += chance
    return steps


def _drawn_often(df: DataFrame, fraction: float, seed: int, key) -> DataFrame:
    """Each row as often as its key's draw says: a Poisson number with the given mean.

    The draw is looked up in the distribution, so a row has the same copies for any partitioning.
    """
    require(0.0 <= fraction <= _MOST_COPIES, f"copies are at most {_MOST_COPIES:.0f} on average")
    name = fresh(df, "_copies")
    draw = _draw(key, seed, "sample_with_replacement")
    # The steps ascend, so those passed by the draw come first.
    passed = F.size(F.filter(F.lit(poisson_steps(fraction)), lambda step: step <= draw))
    drawn = df.withColumn(name, passed).where(F.col(name) > 0)
    return drawn.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).drop(name)


def sample_by(df: DataFrame, column: str, fractions, seed: int, key=None) -> DataFrame:
    """A fraction per stratum, listed by the text form of the value.

    Strata that are not listed and NULL are left out.
    """
    check_columns(df, [column])
    listed = [(str(k), float(v)) for k, v in pairs(fractions)]
    require(bool(listed), "at least one stratum is needed")
    table = F.create_map(*[F.lit(x) for item in listed for x in item])
    share = F.coalesce(F.try_element_at(table, col(column).cast("string")), F.lit(0.0))
    return df.where(_draw(key, seed, "sample_by") < share)


def random_split(df: DataFrame, weights, seed: int, key=None) -> tuple[DataFrame, ...]:
    """Disjoint parts that together are the input, sized by the weights.

    One number ``r`` means the weights ``r`` and ``1 - r``.
    """
    if isinstance(weights, (int, float)):
        require(0.0 <= weights <= 1.0, "the ratio must be between 0 and 1")
        weights = [weights, 1.0 - weights]
    weights = [float(w) for w in weights]
    require(all(w >= 0 for w in weights) and sum(weights) > 0, "weights must be positive")
    if key is None:
        return tuple(df.randomSplit(weights, seed))
    draw = _draw(key, seed, "random_split")
    edges = [sum(weights[:i]) / sum(weights) for i in range(len(weights))] + [1.0]
    return tuple(df.where((draw >= F.lit(low)) & (draw < F.lit(high)))
                 for low, high in zip(edges, edges[1:]))


def split_by(df: DataFrame, column: str, values) -> tuple[DataFrame, ...]:
    """One frame per listed value."""
    check_columns(df, [column])
    return tuple(df.where(col(column) == F.lit(v)) for v in values)
