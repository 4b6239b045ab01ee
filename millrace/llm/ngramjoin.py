"""N-gram Jaccard join with prefix filters under several global orders of the shingles.

If two sets have a Jaccard similarity of at least t, then under any order of all shingles they share
one of the first n - ceil(t * n) + 1 shingles of each. More exactly: a pair of sizes n and m needs an
overlap of a = ceil(t / (1 + t) * (n + m)), so its first common shingle is among the first n - a + 1
of the one and m - a + 1 of the other. Candidates are found by the first order: rare shingles before
frequent ones, then by hash. They must also pass this test under every other order (hash orders with
seeds of their own) before their texts are compared in full.

Before that, a bitmap of 512 bits is compared: a shingle toggles one bit, so the bits in which two
sets differ are at most as many as the shingles in which they differ, and these are at most
n + m - 2a for a link.

No group is expanded into all its pairs:
* documents with the same words are one node from the start;
* in every bucket of documents that share a prefix shingle, all are compared with one, the pivot;
* components of the links found so far need no more links inside, so only pairs between different
  components of a bucket are compared, in further rounds with other pivots and at last directly.
Every pair that shares a bucket is thus either compared or already in one component, which gives the
exact components.

Which shingles are frequent is counted over all documents, batch by batch; what a batch has only
once is left out of the counts. The order only has to be the same for all documents, so neither this
nor the bound on the list of frequent shingles can change a result.

Defined results: without words a document has no shingles, links with nothing, and is a component of
its own; with fewer words than a shingle takes, all its words are its one shingle. Rows that repeat
an id and text are copies like any others; different texts under one id are one node if both sets of
copies are named by it. Rows with a null id are compared like all others, by a key made from their
text, above all ids (ids are below 2**62); a component of such rows alone has the name null. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.components import connected_components
from millrace.llm.text import partitions
from millrace.util import col, fresh, require, written

_SEEDS = (0x51ED270B, 0x2545F491)  # one for each further order
_COUNT_AT = 1_500_000  # shingles that a task counts together


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def least_overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def prefix_under(tokens: np.ndarray, seed: int, n: int) -> np.ndarray:
    """The n smallest keys of the tokens under another order, ascending."""
    keys = shingles.mix(tokens ^ np.uint64(seed))
    return np.sort(keys if n >= len(keys) else np.partition(keys, n - 1)[:n])


def rare_first(tokens: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """The first n tokens under (frequent last, hash). ``tokens`` ascend."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[:n]


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint64).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], k: int
           ) -> Iterator[tuple[int | None, str | None, np.ndarray]]:
    """(id, text, set of shingles)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column("text").to_pylist()
            yield from zip(part.column("id").to_pylist(), texts, shingles.shingle_sets(texts, k))


def frequent_shingles(docs: DataFrame, k: int, least: int, most: int) -> np.ndarray:
    """The ``most`` most frequent shingles at most, with ``least`` documents or more; ascending."""
    def count(batches):
        held, n = [], 0

        def counted():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            again = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(tokens[again])), pa.array(counts[again].astype(np.int64))],
                names=["token", "n"])
        for _, _, tokens in _texts(batches, k):
            held.append(tokens)
            n += len(held[-1])
            if n >= _COUNT_AT:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    found = (docs.mapInArrow(count, "token long, n long").groupBy("token")
             .agg(F.sum("n").alias("n")).where(F.col("n") >= least)
             .orderBy(F.col("n").desc(), "token").limit(most).select("token").toPandas())
    return np.sort(found["token"].to_numpy(dtype=np.int64).view(np.uint64))


_NAMELESS = 1 << 62
_BITS = 512
_BITMAP = [f"bits_{i}" for i in range(_BITS // 64)]
_PROFILE = ("id long, check_a long, check_b long, n_shingles long, prefix array<long>, "
            + ", ".join(f"{b} long" for b in _BITMAP))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each of 512 classes, as 64-bit numbers."""
    classes = (tokens >> np.uint64(17)) % np.uint64(_BITS)
    parity = np.bincount(classes.astype(np.int64), minlength=_BITS).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def _bits_fit(a: str, b: str, n: str, m: str, percent: int) -> Column:
    """Whether the bitmaps (columns named by prefix) differ in no more bits than a link allows."""
    differ = sum((F.bit_count(F.col(a + x).bitwiseXOR(F.col(b + x))) for x in _BITMAP[1:]),
                 F.bit_count(F.col(a + _BITMAP[0]).bitwiseXOR(F.col(b + _BITMAP[0]))))
    return differ <= F.col(n) + F.col(m) - 2 * _least(F.col(n) + F.col(m), percent)


def _least(total: Column, percent: int) -> Column:
    """``least_overlap`` of two sizes with this sum."""
    return F.ceil(F.lit(percent) * total / F.lit(100 + percent))


def _profiles(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: a 128-bit hash of its words, the size of its set, its prefix of the first order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        rows = []
        for identifier, text, tokens in _texts(batches, k):
            words = shingles.split_words(text)
            whole = xxhash.xxh3_128_intdigest(b" ".join(words))
            first = rare_first(tokens, shared.value, prefix_size(len(tokens), percent))
            rows.append((identifier, whole >> 64, whole & (1 << 64) - 1, len(tokens),
                         _signed(first), bitmap(tokens)))
            if len(rows) == 1024:
                yield _profile_batch(rows)
                rows = []
        yield _profile_batch(rows)
    return docs.mapInArrow(run, _PROFILE)


def _profile_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, high, low, sizes, firsts, bits = zip(*rows) if rows else ([], [], [], [], [], [])
    maps = np.stack(bits) if rows else np.zeros((0, len(_BITMAP)), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
    flat = np.concatenate(firsts) if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(_signed(np.array(high, dtype=np.uint64))),
         pa.array(_signed(np.array(low, dtype=np.uint64))), pa.array(sizes, pa.int64()),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
         *[pa.array(np.ascontiguousarray(maps[:, i])) for i in range(len(_BITMAP))]],
        names=["id", "check_a", "check_b", "n_shingles", "prefix", *_BITMAP])


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """(token, node, n_shingles, place, pivot, n_pivot) of the buckets with two nodes or more.

    ``place`` is the token's place in the node's order.

    The rows come sorted by token, so a task holds one row of a bucket at a time; the pivot is the
    bucket's smallest node.
    """
    names = ["token", "node", "n_shingles", "place", "pivot", "n_pivot"]

    def run(batches):
        last, first, alone = None, None, True  # the token before, and its first row
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names[:4])):
                if row[0] != last:
                    last, first, alone = row[0], row, True
                elif row[1] != first[1]:
                    if alone:
                        out.append((*first, *first[1:3]))
                        alone = False
                    out.append((*row, *first[1:3]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], names=names)

    placed = rows.repartition(partitions(rows.sparkSession), "token")
    return placed.sortWithinPartitions("token", "node").mapInArrow(
        run, ", ".join(f"{n} long" for n in names))


def _between_components(buckets: DataFrame, component: DataFrame, number: int) -> DataFrame:
    """The buckets that hold more than one component, with another pivot."""
    placed = (buckets.select("token", "node", "n_shingles", "place").join(component, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    row = F.struct("node", "n_shingles", "component")
    several = (placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min_by(row, F.xxhash64("token", "node", F.lit(number))).alias("p"))
        .where(F.col("low") != F.col("high"))
        .select("token", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("n_pivot"),
                F.col("p.component").alias("pivot_component")))
    return placed.join(several, "token")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _across(live: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes from different components that pass the first order's test in some bucket.

    The smaller set's place must be among its first n - 2tn / (1 + t) + 1, whatever the other is.
    """
    rows = (live.select("token", "node", "n_shingles", "place", "component")
            .join(bitmaps.drop("n_shingles"), "node")
            .select("token", "node", "n_shingles", "place", "component", *_BITMAP))
    first = F.col("n_shingles") - _least(2 * F.col("n_shingles"), percent)
    small = rows.where(F.col("place") <= first).toDF(
        "token", "a", "n", "place_a", "component_a", *[f"a_{x}" for x in _BITMAP])
    large = rows.toDF("token", "b", "m", "place_b", "component_b", *[f"b_{x}" for x in _BITMAP])
    overlap = _least(F.col("n") + F.col("m"), percent)
    return small.join(large, "token").where(
        (F.struct("n", "a") < F.struct(F.col("m").alias("n"), F.col("b").alias("a")))
        & (F.col("component_a") != F.col("component_b"))
        & (F.col("place_a") <= F.col("n") - overlap) & (F.col("place_b") <= F.col("m") - overlap)
        & _bits_fit("a_", "b_", "n", "m", percent)
    ).select(*_pair("a", "b"))


def _possible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    def side(name, size):
        return bitmaps.toDF(name, size, *[f"{name}_{x}" for x in _BITMAP])
    return (pairs.join(side("a", "n"), "a").join(side("b", "m"), "b")
            .where(_bits_fit("a_", "b_", "n", "m", percent)).select("a", "b"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the other orders' filters and then the comparison in full."""
    # The last join sorts by a: pairs with one pivot lie together, and its set is made once.
    together = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
                .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))

    def run(batches):
        known: dict[str, tuple] = {}

        def prepare(texts: set[str]) -> None:
            if len(known) > 64:
                for text in known.keys() - texts:
                    del known[text]
            new = list(texts - known.keys())
            for text, tokens in zip(new, shingles.shingle_sets(new, k)):
                n = prefix_size(len(tokens), percent)
                known[text] = tokens, [prefix_under(tokens, s, n) for s in _SEEDS]

        def passes(left: str, right: str) -> bool:
            (x, x_first), (y, y_first) = known[left], known[right]
            least = least_overlap(len(x), len(y), percent)
            a, b = len(x) - least + 1, len(y) - least + 1
            if not all(len(np.intersect1d(p[:a], q[:b], assume_unique=True))
                       for p, q in zip(x_first, y_first)):
                return False
            common = len(np.intersect1d(x, y, assume_unique=True))
            return similar(common, len(x), len(y), percent)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = list(zip(*(part.column(c).to_pylist()
                                  for c in ("a", "b", "text_a", "text_b"))))
                prepare({text for row in rows for text in row[2:]})
                out = [(a, b) for a, b, left, right in rows if passes(left, right)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[], []])],
                    names=["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def row_key(identifier: str = "doc_id", text: str = "text") -> Column:
    """What names a row while documents are compared: its id, or else a hash of its text."""
    return F.coalesce(col(identifier).cast("bigint"), F.lit(_NAMELESS).cast("bigint")
                      + F.shiftrightunsigned(F.xxhash64(col(text)), 2))


def one_of_each(df: DataFrame, identifier: str = "doc_id", text: str = "text", **options
                ) -> DataFrame:
    """One row of each component: that with the smallest id. Rows without words all stay, and so
    does one row of those that repeat an id and text."""
    found = jaccard_components(df, identifier, text, **options)
    key, same = fresh(df, "_key"), fresh(df, "_same")
    stays = (found.where(F.col("key") == F.col("component_key")).select(F.col("key").alias(key))
             .distinct())
    keyed = df.withColumns({key: row_key(identifier, text), same: F.xxhash64(col(text))})
    return keyed.join(stays, key, "left_semi").dropDuplicates([key, same]).drop(key, same)


def jaccard_components(df: DataFrame, identifier: str = "doc_id", text: str = "text", k: int = 4,
                       percent: int = 85, frequent_least: int = 50,
                       frequent_most: int = 1_000_000, star_rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, key, component_key) for every row: components of documents
    linked by at least ``percent`` similarity. The keys are ids, but never null (``row_key``)."""
    require(0 < percent <= 100 and k > 0 and star_rounds > 0, "percent is 1 to 100, k at least 1")
    docs = df.select(row_key(identifier, text).alias("id"), col(text).alias("text"))
    frequent = frequent_shingles(docs, k, frequent_least, frequent_most)
    profiles = written(_profiles(docs, k, percent, frequent), "profiles")
    words = ["check_a", "check_b"]
    # Rows with the same words are one node, named by the smallest id.
    nodes = profiles.groupBy(*words).agg(F.min("id").alias("node"))
    chosen = profiles.join(nodes.withColumnRenamed("node", "id"), [*words, "id"], "left_semi")
    rows = (chosen.select(F.col("id").alias("node"), "n_shingles", F.posexplode("prefix"))
            .select("node", "n_shingles", F.col("pos").cast("bigint").alias("place"),
                    F.col("col").alias("token")))
    buckets = written(_shared_buckets(rows), "buckets")
    wanted = buckets.select(F.col("node").alias("id")).distinct()
    texts = written(docs.join(wanted, "id", "left_semi").distinct()
                    .withColumnRenamed("id", "node"), "candidates")

    bitmaps = written(profiles.join(wanted, "id", "left_semi").select(
        F.col("id").alias("node"), "n_shingles", *_BITMAP).dropDuplicates(["node"]), "bitmaps")

    live, links, compared = buckets, None, None
    for number in range(star_rounds + 1):
        if number < star_rounds:
            pairs = live.where((F.col("node") != F.col("pivot"))
                               & _sizes_fit("n_shingles", "n_pivot", percent))
            if number:
                pairs = pairs.where(F.col("component") != F.col("pivot_component"))
            pairs = _possible(pairs.select(*_pair("node", "pivot")).distinct(), bitmaps, percent)
        else:
            pairs = _across(live, bitmaps, percent).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(_verified(pairs, texts, k, percent), "found")
        links = found if links is None else links.unionByName(found)
        compared = pairs if compared is None else compared.unionByName(pairs)
        component = written(connected_components(links), "components")
        if number < star_rounds:
            live = written(_between_components(buckets, component, number), "live")
            if live.isEmpty():
                break
    named = (profiles.drop("prefix", *_BITMAP).join(nodes, words).join(component, "node", "left")
             .withColumn("component_id", F.coalesce("component", "node")))
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))

    def real(c):
        return F.when(c < _NAMELESS, c)
    return named.select(real(F.col("id")).alias("id"), "n_shingles",
                        real(own).alias("component_id"), F.col("id").alias("key"),
                        own.alias("component_key"))
