"""Words, lines and shared helpers of the training-data operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, besides the blank.
OTHER_SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")
ALL_SPACES = " \t\n\x0b\x0c\r"


def flat(text: Column) -> Column:
    """The text with a blank for every white-space character; empty for null."""
    text = F.coalesce(text, F.lit(""))
    for c in OTHER_SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def flat_words(flat_text: Column) -> Column:
    return F.array_remove(F.split(flat_text, " "), "")


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]``; none for null. Plain replacements keep regular
    expressions out of the way: splitting at one fixed character is several times faster."""
    return flat_words(flat(text))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_among(points: Column, value: Column, size: int) -> Column:
    """How many of the ascending ``points`` (an array of ``size``) are at most ``value``.

    A binary search written as a fold over the powers of two, so that a row costs log(size) steps.
    """
    steps = [1 << b for b in range(size.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(points, at + step - 1) <= value, at + step).otherwise(at))
