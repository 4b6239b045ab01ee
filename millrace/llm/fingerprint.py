"""Order MinHash fingerprints of texts.

The k-mers of a text (k tokens in a row) are numbered by occurrence, so that a k-mer that comes a
second time counts as another element. Each element falls into one of ``bins`` by its hash; a bin
keeps its ``keep`` smallest elements, puts them back into text order, and the hash of that tuple is
the bin's component. Two fingerprints agree in a component only if the same elements are smallest
and come in the same order, so likeness follows edit distance rather than shared words alone.

Everything is a column expression within a row: nothing is exploded and no key is shuffled.
Elements are whole numbers of (hash, position), because sorting whole numbers is compiled.

Tokens are words; a word of more than ``LONG_WORD`` code points counts by its characters, so that
text without blanks has k-mers too.

Defined results: null counts as an empty text; a text without words has no component, and two such
texts are alike (1.0); a text of fewer than k tokens is one k-mer. Equal texts have equal
fingerprints, and every row is treated by itself, so repeated rows get equal results. Columns of the
input are kept, whatever their names; only one with the name of the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import partitions, rank_among, words
from millrace.util import col, fresh, require

LONG_WORD = 64
_POSITION_BITS = 28  # an array cannot hold more elements than a row has bytes
_POSITION = (1 << _POSITION_BITS) - 1
_VALUE_BITS = 29


def _cut_long(tokens: Column) -> Column:
    def characters(word):
        return F.when(F.length(word) > LONG_WORD, F.split(word, "")).otherwise(F.array(word))
    return F.when(F.exists(tokens, lambda x: F.length(x) > LONG_WORD),
                  F.flatten(F.transform(tokens, characters))).otherwise(tokens)


def _kmers(hashes: Column, k: int) -> Column:
    """A hash for every k tokens in a row; one for a shorter text, none for an empty one."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0)))
    return (F.when(F.size(hashes) >= k, F.transform(
        starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + d) for d in range(1, k)])))
        .when(F.size(hashes) > 0, F.array(F.xxhash64(hashes)))
        .otherwise(F.array().cast("array<bigint>")))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS),
                      F.lit(False))


def _element(value: Column, position: Column) -> Column:
    """The upper 35 bits of a hash above 28 bits of position: never negative."""
    upper = F.shiftrightunsigned(value, 64 - 35)
    return F.shiftleft(upper, _POSITION_BITS).bitwiseOR(position.cast("bigint"))


def order_minhash(df: DataFrame, text: str, into: str, k: int = 5, bins: int = 64, keep: int = 2
                  ) -> DataFrame:
    """Add the fingerprint of ``text`` as an array with one number (bin, tuple hash) per used bin."""
    bin_bits = bins.bit_length() - 1
    require(bins == 1 << bin_bits and 1 <= bin_bits <= 6, "bins is a power of two, 2 to 64")
    require(keep >= 1 and k >= 1, "keep and k are at least 1")
    names = {c: fresh(df, f"_{into}_{c}") for c in "htgpqr"}
    h, t, g, p, q, r = (col(names[c]) for c in "htgpqr")
    shift = _POSITION_BITS + 35 - bin_bits

    def bin_of(x):
        return F.shiftright(x, shift)

    df = df.withColumn(names["t"], words(col(text)))
    df = df.withColumn(names["h"], F.transform(_cut_long(t), lambda x: F.xxhash64(x)))
    df = df.withColumn(names["g"], _kmers(h, k))
    # Texts in which some k-mer comes again: bring equal k-mers together in text order.
    packed = F.sort_array(F.transform(g, lambda x, i: F.shiftleft(
        F.shiftright(x, _POSITION_BITS), _POSITION_BITS).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn(names["p"], F.when(F.size(F.array_distinct(g)) < F.size(g), packed))
    steps = F.array(*[F.lit(1 << b) for b in range(_POSITION_BITS, -1, -1)])

    def occurrence(x, i):
        """How many equal ones stand before: the array is sorted, so their number is bisected."""
        return F.when(_same(F.get(p, i - 1), x), F.aggregate(
            steps, F.lit(0), lambda n, step: F.when(
                (n + step <= i) & _same(F.get(p, i - n - step), x), n + step).otherwise(n))
        ).otherwise(0)

    def numbered(x, i):
        n = occurrence(x, i)
        return _element(F.when(n == 0, x).otherwise(F.xxhash64(F.shiftright(x, _POSITION_BITS), n)),
                        x.bitwiseAND(F.lit(_POSITION)))

    df = df.withColumn(names["q"], F.sort_array(
        F.when(p.isNull(), F.transform(g, _element)).otherwise(F.transform(p, numbered))))
    smallest = F.filter(q, lambda x, i: (i < keep) | (bin_of(x) != bin_of(F.get(q, i - keep))))

    def by_position(x):
        value = F.shiftright(x, _POSITION_BITS).bitwiseAND(F.lit((1 << (35 - bin_bits)) - 1))
        place = F.shiftleft(x.bitwiseAND(F.lit(_POSITION)), 35 - bin_bits)
        return F.shiftleft(bin_of(x), shift).bitwiseOR(place).bitwiseOR(value)

    df = df.withColumn(names["r"], F.sort_array(F.transform(smallest, by_position)))
    low = F.lit((1 << (35 - bin_bits)) - 1)

    def component(x, i):
        values = [x.bitwiseAND(low)]
        for d in range(1, keep):
            other = F.get(r, i + d)
            values.append(F.when(bin_of(other) == bin_of(x), other.bitwiseAND(low))
                          .otherwise(F.lit(-1).cast("bigint")))
        tuple_hash = F.shiftrightunsigned(F.xxhash64(*values), 32)
        first = (i == 0) | (bin_of(F.get(r, i - 1)) != bin_of(x))
        return F.when(first, F.shiftleft(bin_of(x), 32).bitwiseOR(tuple_hash))

    return (df.withColumn(into, F.array_compact(F.transform(r, component)))
            .drop(*names.values()))


def likeness(a: Column, b: Column) -> Column:
    """The share of components on which two fingerprints agree, of those that either has."""
    def used(x):
        return F.transform(x, lambda c: F.shiftright(c, 32))
    either = F.size(F.array_union(used(a), used(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda c: F.lower(F.hex(c))), " ")


def next_rows(df: DataFrame, order: str, blocks: int | None = None) -> tuple[DataFrame, Window]:
    """Cut the rows into blocks of the order; return them with the window to look ahead in.

    Over the window, ``lead`` of any column is the value of the next row in the whole table, and of
    the first row after the last. The first rows of each block are also guests at the end of the
    block before, so that no row of another block is needed; drop rows with ``_guest`` afterwards.
    Block limits are values of the column found by an approximate percentile: as many as there are
    blocks (four per shuffle partition), whatever the size of the table. Rows without a value come
    first; rows with equal values, which share a block, are ordered by a hash of the whole row.
    """
    blocks = blocks or 4 * partitions(df.sparkSession)
    shares = [(i + 1) / blocks for i in range(blocks - 1)]
    found = df.agg(
        F.percentile_approx(col(order), shares, 100 * blocks).alias("limits"),
        F.min(col(order)).alias("first"),
        F.max(F.when(col(order).isNull(), 1).otherwise(0)).alias("holes")).first()
    limits = sorted(set(found["limits"] or [])) if blocks > 1 else []
    points = (F.lit(limits) if limits else F.array()).cast("array<bigint>")
    block = F.coalesce(rank_among(points, col(order), len(limits)), F.lit(0))
    last = len(limits)
    heads = col(order).isNull() if found["holes"] else col(order) == F.lit(found["first"])
    places = F.array(
        F.struct(block.alias("block"), F.lit(0).alias("guest")),
        F.when(F.array_contains(points, col(order)),
               F.struct((block - 1).alias("block"), F.lit(1).alias("guest"))),
        F.when(F.coalesce(heads, F.lit(False)),
               F.struct(F.lit(last).alias("block"), F.lit(1).alias("guest"))))
    spread = (df.withColumn("_tie", F.xxhash64(*[col(c) for c in df.columns]))
              .withColumn("_place", F.explode(F.array_compact(places)))
              .withColumns({"_block": F.col("_place.block"), "_guest": F.col("_place.guest")})
              .drop("_place"))
    window = Window.partitionBy("_block").orderBy(
        "_guest", col(order).asc_nulls_first(), "_tie")
    return spread, window


def edit_tail(text: Column, other: Column, part: int = 4) -> Column:
    """The text with its last quarter replaced by as much of the head of the other."""
    n = F.length(text)
    tail = F.floor(n / part).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - tail), F.substring(other, F.lit(1), tail))


def fingerprint_edits(df: DataFrame, identifier: str = "doc_id", text: str = "text",
                      k: int = 5, bins: int = 64, keep: int = 2) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, with the likeness to the edited text
    and to the next document. Any other columns of the documents are left out."""
    docs = df.select(col(identifier).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    marked = order_minhash(docs, "text", "print", k, bins, keep)
    rows, window = next_rows(marked, "id")
    ahead = rows.withColumns({"_next": F.lead("text").over(window),
                              "_next_print": F.lead("print").over(window)})
    # A table of one row is its own next row.
    edited = (ahead.where(F.col("_guest") == 0)
              .withColumn("edited", edit_tail(F.col("text"), F.coalesce("_next", "text"))))
    both = order_minhash(edited, "edited", "edited_print", k, bins, keep)
    return both.select(
        F.col("id").alias(identifier), F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.coalesce("_next_print", "print")).alias("near_next"))
