"""Word vectors that stay a table, as a stage that can be saved.

Skip-gram with negative samples. Neighbouring rows make shards of a bounded number of words; the texts
of a single pass are learned where they are read, and sent nowhere. A learner for each shard holds the
vectors of that shard's words only; after each pass a word's vectors are averaged over the shards that
have it, weighted by how often. So no vocabulary is whole anywhere, not on the driver either. A word's first vector is drawn from a hash of the word, and thus the same in all
shards. Spark's own fit predicts along a Huffman tree of all words, which its driver must hold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.ml.vocabulary import _numbered
from millrace.util import col, fresh, require, written

VECTORS = "word string, vector array<float>, n long"
_SHARD = 1 << 19     # words of a shard
_BATCH = 1 << 11     # places whose pairs are learned together
_DRAWN = 64          # negative samples of a batch
_NEGATIVES = 5       # for how many negative samples of a pair they count
_MOST = 16           # a word's step in a batch is at most that of so many pairs
_COMMON = 1 << 24    # bytes of the vectors of frequent words that are broadcast
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# --- Inside tasks -----------------------------------------------------------

def first_vectors(words: list[str], size: int, seed: int) -> np.ndarray:
    """Even draws between -0.5 and 0.5, over the size, by word, slot and seed."""
    data = [w.encode(errors="surrogatepass") for w in words]
    known = np.array([zlib.crc32(d) << 32 | zlib.crc32(d, 0x5BD1E995) for d in data], np.uint64)
    x = (known[:, None] ^ np.uint64(seed & 0xFFFFFFFF)) * _ODD[1] + np.arange(
        1, size + 1, dtype=np.uint64) * _ODD[0]
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return ((((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53 - 0.5) / size).astype(np.float32)


def _add(table: np.ndarray, at: np.ndarray, steps: np.ndarray) -> None:
    """Add up the steps of each word, as many as ``_MOST`` at full length."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.diff(at, prepend=-1))
    many = np.diff(np.append(start, len(at)))
    sums = np.add.reduceat(steps[order], start, axis=0)
    table[at[start]] += sums * np.minimum(1, _MOST / many)[:, None].astype(np.float32)


def learn(codes: np.ndarray, sentence: np.ndarray, inner: np.ndarray, outer: np.ndarray,
          window: int, step: float, random: np.random.Generator) -> None:
    """One pass over the words of a shard, given by their codes and the numbers of their sentences."""
    weights = np.bincount(codes, minlength=len(inner)) ** 0.75
    upto = np.cumsum(weights / weights.sum())
    reach = random.integers(1, window + 1, len(codes))
    for low in range(0, len(codes), _BATCH):
        place = np.arange(low, min(low + _BATCH, len(codes)))
        found = []
        for d in range(1, window + 1):
            for other in (place - d, place + d):
                safe = np.clip(other, 0, len(codes) - 1)
                near = (other == safe) & (sentence[safe] == sentence[place]) & (reach[place] >= d)
                found.append((place[near], other[near]))
        word, context = (codes[np.concatenate(p)] for p in zip(*found))
        if not len(word):
            continue
        drawn = np.minimum(np.searchsorted(upto, random.random(_DRAWN)), len(inner) - 1)
        rate = np.float32(step * max(1e-4, 1 - low / len(codes)))
        a, b, c = inner[context], outer[word], outer[drawn]
        hit = rate * (1 - 1 / (1 + np.exp(-(a * b).sum(axis=1, keepdims=True))))
        miss = -rate / (1 + np.exp(-(a @ c.T))) * np.float32(_NEGATIVES / _DRAWN)
        miss[word[:, None] == drawn[None, :]] = 0
        _add(inner, context, hit * b + miss @ c)
        _add(outer, word, hit * a)
        _add(outer, drawn, (miss.T @ a) * np.float32(min(1, _MOST / len(a))) * _DRAWN / _NEGATIVES)


# --- On the cluster ---------------------------------------------------------

_ROWS = "shard long, words array<string>, word string, inner array<float>, outer array<float>"


def _dealt(batches, most: int):
    """(shard, words): neighbouring rows, up to ``most`` words together."""
    from pyspark import TaskContext
    shard, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
        numbers = np.empty(len(sizes), np.int64)
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                shard, held = shard + 1, 0
            numbers[i], held = shard, held + n
        yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column("words")],
                                         names=["shard", "words"])


def _learned(rows: DataFrame, size: int, window: int, step: float, seed: int, most: int = 0) -> DataFrame:
    """(shard, word, n, inner, outer): each shard's words with their vectors after a pass.

    The rows of a shard stand together, or are dealt here, ``most`` words to a shard.
    """
    out = pa.schema([("shard", pa.int64()), ("word", pa.string()), ("n", pa.int64()),
                     ("inner", pa.list_(pa.float32())), ("outer", pa.list_(pa.float32()))])

    def vectors_of(shard, batches):
        table = pa.Table.from_batches(batches)
        text = table.filter(pa.compute.is_valid(table["words"]))["words"].combine_chunks()
        sizes = text.value_lengths().to_numpy(zero_copy_only=False)
        words = pa.compute.list_flatten(text).dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        inner = first_vectors(names, size, seed)
        outer = np.zeros_like(inner)
        if not most:
            known = table.filter(pa.compute.is_valid(table["word"]))
            if known.num_rows:
                at = pa.compute.index_in(known["word"], words.dictionary).to_numpy()
                for mine, name in ((inner, "inner"), (outer, "outer")):
                    mine[at] = pa.compute.list_flatten(known[name]).to_numpy().reshape(-1, size)
        learn(codes, np.repeat(np.arange(len(sizes)), sizes), inner, outer, window, step,
              np.random.default_rng([seed & 0xFFFFFFFF, shard]))
        offsets = np.arange(0, inner.size + 1, size, dtype=np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(names), shard)), words.dictionary,
            pa.array(np.bincount(codes, minlength=len(names))),
            *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.reshape(-1)))
              for v in (inner, outer))], schema=out)

    def run(batches):
        shard, held = None, []
        for batch in _dealt(batches, most) if most else batches:
            numbers = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist() + [len(numbers)]
            for a, b in zip(edges, edges[1:]):
                if numbers[a] != shard and held:
                    yield vectors_of(shard, held)
                    held = []
                shard = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield vectors_of(shard, held)
    return rows.mapInArrow(
        run, "shard long, word string, n long, inner array<float>, outer array<float>")


def _averaged(learned: DataFrame, size: int, sides: tuple[str, ...]) -> DataFrame:
    """(word, n, inner, outer), averaged over shards; vectors are sent as they are, once."""
    sent = learned.select("word", "n", *sides).repartition("word")
    sums = sent.groupBy("word").agg(F.sum("n").alias("n"), *[
        F.sum(F.col("n") * F.get(side, F.lit(i))).alias(f"{side}{i}")
        for side in sides for i in range(size)])
    return sums.select("word", "n", *[
        F.array(*[(F.col(f"{side}{i}") / F.col("n")).cast("float") for i in range(size)]).alias(side)
        for side in sides])


def frequent(table: DataFrame, size: int) -> Column:
    """Which words of a table of (word, n, vectors of ``size`` floats) are so frequent that they are
    broadcast: those with the largest n, as many as a few MB hold."""
    step = F.floor(F.log2("n") * 8).alias("step")
    few, least = _COMMON // (4 * size + 48), None
    for r in sorted(table.where("n > 0").groupBy(step).agg(
            F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        few -= r.words
        if few < 0:
            break
        least = r.least
    return F.lit(False) if least is None else F.coalesce(F.col("n") >= least, F.lit(False))


def with_words(terms: DataFrame, table: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The terms with the row of their ``word`` in a table of (word, n, vectors of ``size`` floats), in
    two parts: those of the frequent words, which are broadcast, and the others.

    Most of a text's terms are in the first part and sent nowhere. Words that the table does not have
    are in the second, without a vector.
    """
    often = frequent(table, size)
    common, rare = table.where(often), table.where(~often)
    return (terms.join(F.broadcast(common), "word"),
            terms.join(F.broadcast(common.select("word")), "word", "left_anti").join(rare, "word", "left"))


def summed(terms: tuple[DataFrame, DataFrame], keys: list[str], vector: str, size: int, stem: str
           ) -> list[DataFrame]:
    """(keys, number of terms, sums of their vectors) of both parts: ``stem`` with the part's number,
    and that with the slot."""
    common, rare = terms
    return [part.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{stem}{k}"), *[
        F.sum(F.get(vector, F.lit(i)).cast("double")).alias(f"{stem}{k}_{i}") for i in range(size)])
        for k, part in enumerate((common, rare.select(*keys, vector).repartition(*keys)))]


def average(stem: str, size: int) -> Column:
    """What the sums of both parts give together, or NULL without a term."""
    def both(tail):
        return sum(F.coalesce(F.col(f"{stem}{k}{tail}"), F.lit(0)) for k in (0, 1))
    return F.when(both("") > 0, F.array(*[both(f"_{i}") / both("") for i in range(size)]))


def fit_word_vectors(df: DataFrame, column: str, out: str, vectorSize: int = 100, minCount: int = 5,
                     maxIter: int = 1, seed: int = 0, numPartitions: int = 1, windowSize: int = 5,
                     stepSize: float = 0.025, maxSentenceLength: int = 1000) -> WordVectors:
    """The vectors of the words that occur ``minCount`` times in a column of word lists.

    ``numPartitions`` shards are the least; there are more where they would hold too many words.
    """
    vectorSize, minCount, maxIter, numPartitions, windowSize, maxSentenceLength, seed = (
        int(n) for n in (vectorSize, minCount, maxIter, numPartitions, windowSize, maxSentenceLength, seed))
    require(min(vectorSize, maxIter, numPartitions, windowSize, maxSentenceLength) > 0,
            "sizes and numbers of word vectors are positive")
    words = F.array_compact(col(column))
    if minCount > 1:
        rows, row = _numbered(df.select(words.alias("words")))
        each = rows.select(F.col(row).alias("row"), F.posexplode("words").alias("at", "word"))
        kept = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minCount)
        sentences = each.join(kept, "word").groupBy("row").agg(F.sort_array(F.collect_list(
            F.struct("at", "word"))).alias("found")).select(F.col("found.word").alias("words"))
        sentences = written(sentences, "sentences")
    else:
        sentences = df.select(words.alias("words"))
    sentences = sentences.where(F.size("words") > 0)
    total = sentences.agg(F.sum(F.size("words"))).first()[0] or 0
    most = min(_SHARD, -(-total // numPartitions) or 1)
    words = F.col("words")
    # Small inputs are read by few tasks, so that their shards are of full size.
    cut = sentences.coalesce(max(numPartitions, -(-total // _SHARD))).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / maxSentenceLength).cast("int")),
        lambda i: F.slice(words, i * maxSentenceLength + 1, maxSentenceLength))).alias("words"))
    shards = max(numPartitions, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if maxIter > 1:  # the shards must stay what they are
        cut = written(cut.mapInArrow(lambda batches: _dealt(batches, most),
                                     "shard long, words array<string>"), "shards")
    vectors = None
    for i in range(maxIter):
        last, at = i + 1 == maxIter, (vectorSize, windowSize, float(stepSize) * (1 - i / maxIter), seed + i)
        if maxIter == 1:
            learned = _learned(cut, *at, most=most)
        else:
            rows = cut.selectExpr("*", "null word", "null inner", "null outer")
            if vectors is not None:
                rows = rows.unionByName(holders.join(vectors, "word").selectExpr(
                    "shard", "null words", "word", "inner", "outer"))
            rows = rows.select(*[F.col(n).cast(kind).alias(n) for n, kind in (
                f.split(" ", 1) for f in _ROWS.split(", "))])
            learned = _learned(rows.repartition(shards, "shard").sortWithinPartitions("shard"), *at)
        if not last:
            learned = written(learned, "learned")
            holders = learned.select("shard", "word")
        vectors = written(_averaged(learned, vectorSize, ("inner",) if last else ("inner", "outer")),
                          "word-vectors")
    stage = WordVectors(inputCol=column, outputCol=out, vectorSize=vectorSize)
    stage.vectors = vectors.select("word", F.col("inner").alias("vector"), "n")
    return stage


class WordVectors(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Joins each word with its vector and averages them per row, over all words of the row."""

    vectorSize = Param(Params._dummy(), "vectorSize", "numbers in a vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, vectorSize=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.vectors: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The rows are read where they are needed, and known by hashes of their words; an error says
        so if a second reading gives other words."""
        require(self.vectors is not None, "the stage has no vectors")
        column, out, size = self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.vectorSize)
        a, b, some, stem = (fresh(dataset, n) for n in ("_a", "_b", "_some", "_sum"))
        words = col(column)
        keyed = dataset.withColumns({a: F.xxhash64(words), b: F.xxhash64(F.lit(1), words),
                                     some: F.coalesce(F.size(words), F.lit(0)) > 0})
        terms = keyed.select(a, b, F.explode(words).alias("word"))
        joined = keyed
        for part in summed(with_words(terms, self.vectors, size), [a, b], "vector", size, stem):
            joined = joined.join(part, [a, b], "left")
        other = F.when(F.col(some), F.raise_error(F.lit("the rows differ between two readings")).cast(
            "array<double>")).otherwise(F.array(*[F.lit(0.0)] * size))
        return joined.select(*[col(c) for c in dataset.columns if c != out],
                             array_to_vector(F.coalesce(average(stem, size), other)).alias(out))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: WordVectors):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.vectors.write.parquet(f"{path}/vectors")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> WordVectors:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.vectors = self.sparkSession.read.schema(VECTORS).parquet(f"{path}/vectors")
        return stage
