"""What filters remove together: every order of a set of filters, from tables of failing ids.

Each filter is judged once, on whole texts, and leaves one table of the ids that fail it. All that is
asked of an order of filters follows from joins of these narrow tables; texts are not read again:

* survivors of a prefix: all ids, left-anti joined with the tables of its filters;
* removals of a step: the ids of its own table, left-anti joined with the tables of the filters before
  it; labels travel with the ids, so label losses are counted there too;
* redundancies: the same ids, left-semi joined with them.

What a prefix keeps does not depend on the order inside it, so prefixes are sets: 2^n of them, not n!.
A set is a bit mask that rides along with an id, and the mask is part of the join's condition, so that
one anti-join (one semi-join) answers all sets. Ids are row numbers, so keys are unique however often
a document id or a text repeats. The joined tables are partitioned by id before the masks are added.

Defined results: a null text counts as empty, a null part as the empty string. A row without an id is
a document of its own: it is nobody's copy, has no labels, and makes no other row a copy. Rows that
repeat an id are documents of their own as well; they are not copies of each other. An id with several
labels is good (toxic) if one of them says so. Very long texts are judged whole. Columns of the input
are not kept, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import partitions, words
from millrace.util import check_columns, col, require, scratch, written

_MOST = 6  # filters: 720 orders

Filter = Callable[[Column, Column], Column]

# Failure conditions on a text and its words.
FILTERS: dict[str, Filter] = {
    "A": lambda text, found: F.size(found) < 100,
    "B": lambda text, found: 100 * F.size(F.array_distinct(found)) < 80 * F.size(found),
    "C": lambda text, found: 100 * (F.length(text) - F.length(F.translate(
        text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text),
    "D": lambda text, found: F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
}
COPY = "E"  # the filter that compares texts with each other


def _facts(df: DataFrame, labels: DataFrame, identifier: str, text: str, part: str,
           filters: dict[str, Filter]) -> DataFrame:
    """One narrow row per document: what it fails by itself, its labels, a hash of its text."""
    whole = df.select(F.monotonically_increasing_id().alias("id"), col(identifier).alias("doc"),
                      F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(col(text), F.lit("")).alias("text"))
    worded = whole.withColumn("words", words(F.col("text")))
    failing = F.array_compact(F.array(*[
        F.when(fails(F.col("text"), F.col("words")), F.lit(name))
        for name, fails in filters.items()]))
    judged = worded.select(
        "id", "doc", "part", failing.cast("array<string>").alias("failing"),
        F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"))
    marks = (labels.where(F.col("doc").isNotNull() & (F.col("good") | F.col("toxic")))
             .groupBy("doc").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic")))
    none = F.lit(False)
    return judged.join(marks, "doc", "left").select(
        *judged.columns, F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def copies(facts: DataFrame) -> DataFrame:
    """The rows whose text a smaller document id has: an anti-join with the first of each text.

    Both columns are keys of the join, so a text with very many copies is spread.
    """
    firsts = facts.groupBy("digest").agg(F.min("doc").alias("doc")).where(F.col("doc").isNotNull())
    return facts.where(F.col("doc").isNotNull()).join(firsts, ["digest", "doc"], "left_anti")


def failing_ids(facts: DataFrame, names: list[str], copy: str | None) -> DataFrame:
    """(filter, id, part, good, toxic), stored as one table for each filter."""
    narrow = ["id", "part", "good", "toxic"]
    own = facts.select(*narrow, F.explode("failing").alias("filter"))
    if copy is not None:
        own = own.unionByName(copies(facts).select(*narrow, F.lit(copy).alias("filter")))
    path = scratch(facts.sparkSession, "failing-ids")
    own.write.partitionBy("filter").parquet(path)
    schema = "id long, part string, good boolean, toxic boolean, filter string"
    stored = facts.sparkSession.read.schema(schema).parquet(path)
    return stored.where(F.col("filter").isin(names))


def audit(df: DataFrame, labels: DataFrame, identifier: str = "doc_id", text: str = "text",
          part: str = "lang", filters: dict[str, Filter] | None = None,
          copy: str | None = COPY) -> DataFrame:
    """One row per part, order of the filters and step.

    ``labels`` has ``doc``, ``good`` and ``toxic``. ``filters`` gives each filter's name, one
    character, and failure condition; ``copy`` names the filter that drops copies, None for none.
    Columns are part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (removals of the step's filter summed over all orders).
    """
    check_columns(df, [identifier, text, part])
    filters = FILTERS if filters is None else filters
    names = sorted([*filters, *([copy] if copy is not None else [])])
    require(all(len(n) == 1 for n in names) and len(set(names)) == len(names),
            "names of filters are single, different characters")
    require(1 <= len(names) <= _MOST, f"between 1 and {_MOST} filters can be audited")

    facts = written(_facts(df, labels, identifier, text, part, filters), "filter-facts")
    failing = failing_ids(facts, names, copy)
    counts, survivors = _steps(failing, names), _survivors(facts, failing, names)
    return _orders(facts, written(counts, "filter-steps"), written(survivors, "survivors"), names)


def _bit(name: Column, names: list[str]) -> Column:
    """The bit of a filter in a mask."""
    return F.pow(F.lit(2), F.instr(F.lit("".join(names)), name) - 1).cast("int")


def _by_id(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "id")


def _met(ids: DataFrame, failing: DataFrame, names: list[str], how: str) -> DataFrame:
    """The (id, mask) of ``ids`` that fail a filter of the mask (left_semi) or none (left_anti)."""
    others = _by_id(failing.select("id", _bit(F.col("filter"), names).alias("bit")))
    a, b = ids.alias("a"), others.hint("shuffle_hash").alias("b")
    inside = F.col("a.mask").bitwiseAND(F.col("b.bit")) != 0
    return a.join(b, (F.col("a.id") == F.col("b.id")) & inside, how)


def _steps(failing: DataFrame, names: list[str]) -> DataFrame:
    """Per part, filter and set of earlier filters: removals, redundancies and label losses."""
    masks = F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))
    own = _by_id(failing).withColumn("bit", _bit(F.col("filter"), names))
    ids = own.withColumn("mask", F.explode(F.filter(
        masks, lambda m: m.bitwiseAND(F.col("bit")) == 0))).drop("bit")
    keys = ["part", "filter", "mask"]
    removed = _met(ids, failing, names, "left_anti").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good_lost"),
        F.count_if("toxic").alias("toxic_lost"))
    redundant = _met(ids, failing, names, "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("redundant"))
    return removed.join(redundant, keys, "full")


def _survivors(facts: DataFrame, failing: DataFrame, names: list[str]) -> DataFrame:
    """Per part and set of filters: how many documents pass all of them."""
    ids = _by_id(facts.select("id", "part")).withColumn(
        "mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    return (_met(ids, failing, names, "left_anti").groupBy("part", "mask")
            .agg(F.count(F.lit(1)).alias("kept")))


def _orders(facts: DataFrame, counts: DataFrame, survivors: DataFrame, names: list[str]
            ) -> DataFrame:
    """All orders of each part, with what the sets of their prefixes gave."""
    orders = ["".join(order) for order in permutations(names)]
    parts = facts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    spread = parts.select("part", F.explode(F.lit(orders)).alias("filter_order"))
    letters = F.split("filter_order", "")
    steps = spread.select("part", "filter_order", F.posexplode(letters).alias("at", "filter"))
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("at")), F.lit(0),
                         lambda mask, name: mask + _bit(name, names))
    own = _bit(F.col("filter"), names)
    steps = (steps.withColumn("mask", before).withColumn("after", F.col("mask") + own)
             .withColumn("others", F.lit((1 << len(names)) - 1) - own))

    def zero(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    alone = counts.select("part", "filter", F.col("mask").alias("others"),
                          F.col("removed").alias("unique_fails"))
    found = (steps.join(counts, ["part", "filter", "mask"], "left")
             .join(alone, ["part", "filter", "others"], "left")
             .join(survivors.withColumnRenamed("mask", "after"), ["part", "after"], "left"))
    filled = found.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter",
        *[zero(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost",
                            "toxic_lost")])
    everywhere = Window.partitionBy("part", "filter")  # one row per order: n! of them
    return filled.withColumn("shapley", F.sum("removed").over(everywhere))
