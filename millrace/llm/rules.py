"""Quality rules: a table of thresholds that becomes one Spark projection.

Each rule is a row (name, measure, least, most). ``measures`` gives the measures as native
expressions over one text column, and ``apply_rules`` turns the whole table into a single boolean
expression, so that a text is read once, without shuffles and without user functions.

Defined results: a null text counts as empty; a text without words has zero for every measure,
fails the base rules and is not kept. Ratios over zero words or lines are zero. Rows are judged one
by one, so repeated rows and ties all get the same verdict. Columns of the input with the names of
measures or verdicts are replaced, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import ALL_SPACES, flat, flat_words
from millrace.util import col, require

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Very common words of the languages that the rules are meant for.
STOP_WORDS = (
    "the be to of and that have with is in "
    "der die und den von das mit ist ein zu "
    "le la les de des et un que en pour "
    "el los que en un por con una del y").split()

WINDOW = 3

_POSITION_BITS = 28  # an array cannot hold more elements than a row has bytes
_POSITION = (1 << _POSITION_BITS) - 1


@dataclass(frozen=True)
class Rule:
    """A text passes if its measure is at least ``least`` and at most ``most``; None: no bound."""
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


BASE_RULES = (
    Rule("enough_words", "n_words", least=50),
    Rule("little_repetition", "repeat_word_percent", most=50),
)

QUALITY_RULES = (
    Rule("word_length", "mean_word_length", least=2, most=12),
    Rule("few_symbols", "symbols_per_word", most=0.1),
    Rule("few_exclamations", "exclamations_per_word", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("few_bullets", "bullet_line_ratio", most=0.9),
    Rule("few_ellipses", "ellipsis_line_ratio", most=0.3),
    Rule("few_repeated_lines", "dup_line_ratio", most=0.6),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.greatest(whole, F.lit(1)))


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _same_hash(a: Column, b: Column) -> Column:
    return F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_POSITION)).cast("int")


def repeated_windows(df: DataFrame, words_column: str, into: str, window: int = WINDOW) -> DataFrame:
    """Add the number of words that lie in a window of words found twice or more in the text.

    Each window gets a 64-bit hash. A sorted array of (upper hash bits, position) brings equal
    windows together; neighbours are compared by their full hashes. Sorting whole numbers is
    compiled and unboxed, so a text of n words costs n log n cheap steps and no shuffle.
    """
    w, h, g, p, u = (col(f"_{into}_{c}") for c in "whgpu")
    named = {c: f"_{into}_{c}" for c in "whgpu"}
    df = df.withColumn(named["h"], F.transform(col(words_column), lambda x: F.xxhash64(x)))
    inner = F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0)))
    df = df.withColumn(named["g"], F.when(F.size(h) >= window, F.transform(
        inner, lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, window)])))
        .otherwise(F.array().cast("array<bigint>")))
    packed = F.sort_array(F.transform(
        g, lambda x, i: F.shiftleft(F.shiftright(x, _POSITION_BITS), _POSITION_BITS)
        .bitwiseOR(i.cast("bigint"))))
    df = df.withColumn(named["p"], F.when(F.size(F.array_distinct(g)) < F.size(g), packed)
                       .otherwise(F.array().cast("array<bigint>")))

    def twice(x, i):
        def equal(other):
            return _same_hash(x, other) & (F.get(g, _position(x)) == F.get(g, _position(other)))
        return (F.coalesce(equal(F.get(p, i - 1)), F.lit(False))
                | F.coalesce(equal(F.get(p, i + 1)), F.lit(False)))

    df = df.withColumn(named["u"], F.sort_array(F.transform(
        F.filter(p, twice), lambda x: x.bitwiseAND(F.lit(_POSITION)))))
    covered = F.aggregate(
        F.transform(u, lambda x, i: F.least(
            F.lit(window).cast("bigint"),
            F.coalesce(F.get(u, i + 1) - x, F.lit(window).cast("bigint")))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn(into, covered).drop(*[named[c] for c in "hgpu"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
            "n_exclamations", "n_filled_lines", "n_bullet_lines", "n_ellipsis_lines",
            "mean_word_length", "symbols_per_word", "exclamations_per_word",
            "repeat_word_percent", "bullet_line_ratio", "ellipsis_line_ratio", "dup_line_ratio")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures that rules can name, as one chain of projections over ``text``.

    The input's own columns travel in a struct, so their names cannot meet those used here.
    """
    kept = [c for c in df.columns if c not in MEASURES]
    df = df.select(F.struct(*[col(c) for c in kept], F.lit(0).alias("_")).alias("_input"),
                   F.coalesce(col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    df = df.withColumn("_flat", flat(t))
    df = df.withColumns({"_words": flat_words(F.col("_flat")), "_lines": F.split(t, "\n")})
    filled = F.filter("_lines", lambda x: F.length(F.trim(x, F.lit(ALL_SPACES))) > 0)
    df = df.withColumn("_lines", filled)
    df = repeated_windows(df, "_words", "n_repeat_words")
    n_lines = F.size("_lines")
    stop = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))).cast("bigint"),
        "n_symbols": _count(t, SYMBOLS).cast("bigint"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_stop_words": F.size(F.array_intersect("_words", stop)).cast("bigint"),
        "n_exclamations": _count(t, "!").cast("bigint"),
        "n_filled_lines": n_lines.cast("bigint"),
        "n_bullet_lines": F.size(F.filter(
            "_lines", lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• ")))
        .cast("bigint"),
        "n_ellipsis_lines": F.size(F.filter(
            "_lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("bigint"),
    })
    n = F.col("n_words")
    df = df.withColumns({
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbols_per_word": _ratio(F.col("n_symbols"), n),
        "exclamations_per_word": _ratio(F.col("n_exclamations"), n),
        "repeat_word_percent": _ratio(100 * F.col("n_repeat_words"), n),
        "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), F.col("n_filled_lines")),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipsis_lines"), F.col("n_filled_lines")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_filled_lines")),
    })
    return df.select(*[F.col("_input").getField(c).alias(c) for c in kept],
                     *[F.col(m) for m in MEASURES])


def passes(rules) -> Column:
    """The whole table of thresholds as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        require(rule.least is not None or rule.most is not None, f"rule {rule.name} has no bound")
        if rule.least is not None:
            verdict = verdict & (col(rule.measure) >= F.lit(rule.least))
        if rule.most is not None:
            verdict = verdict & (col(rule.measure) <= F.lit(rule.most))
    return verdict


def apply_rules(df: DataFrame, text: str = "text", base=BASE_RULES, rules=QUALITY_RULES) -> DataFrame:
    """Add all measures, ``base_failed`` and ``kept``."""
    return (measures(df, text).withColumn("base_failed", ~passes(base))
            .withColumn("kept", ~F.col("base_failed") & passes(rules)))
