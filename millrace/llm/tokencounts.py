"""How many tokens each text has, without writing tokens and without a shuffle of pre-tokens.

A byte-level merge vocabulary first cuts a text into pre-tokens and then merges inside each, so a
text's count is the sum of its pre-tokens' lengths. These come from two tiers, both beside the task:
1. ``frequent_lengths`` reads all texts once. Every task keeps a summary of its most frequent
   pre-tokens (counters that are lowered together when there are too many, so that what is frequent
   stays), and summaries, not pre-tokens, are sent on and merged. The driver gets ``frequent``
   pre-tokens at most, has the library encode them, and broadcasts their lengths as a compact hash
   table: 18 bytes a slot, whatever the size of the corpus.
2. ``count_tokens`` looks every distinct pre-token of a block up in that table. What is not there is
   looked up in the worker's own cache of bounded size, and only what misses both is encoded.
The table decides how fast a count is found, never what it is.

A character that the pattern and the library may class differently (their Unicode versions can
differ) is found when a worker first meets it, and texts that hold one are encoded whole. The same
holds for texts with added tokens that take part of the text around them.

Defined results: a null text counts as empty and has no tokens. Strings of special tokens inside a
text are the special tokens, as is the library's default. Very long texts are read piece by piece, cut
where no pre-token can reach across. Rows are counted one by one, so ties, repeated rows and missing
ids do not matter. All columns are kept; columns with the names of the results are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import partitions
from millrace.util import check_columns, col, require

# Fixed value: how byte-level vocabularies cut a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = 1 << 16  # characters of a long text that are cut at a time
_BLOCK = 1 << 18  # pre-tokens that are looked up at a time
_LONGEST = 64     # characters of a pre-token that the table may hold
_SUMMARY = "words array<string>, counts array<bigint>"
_SLICE = 4096     # words of one row of a summary
_FAN_IN = 16      # summaries that a task merges


class PreTokens:
    """Cuts texts as the library does, and encodes pre-tokens and whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.find = regex.compile(_PATTERN).findall
        self.spans = regex.compile(_PATTERN).finditer
        added = list(self.model.get_added_tokens_decoder().values())
        plain = [t.content for t in added
                 if not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        # One added token cuts a text in a single way; several could overlap.
        self.special = plain[0] if len(added) == len(plain) == 1 else None
        self.others = [] if self.special else [t.content for t in added]
        self.classed: dict[str, bool] = {}

    def _same_class(self, c: str) -> bool:
        probe = f"a{c}1{c}!{c} {c}{c} a{c} 's{c}"
        return [m.span() for m in self.spans(probe)] == [
            at for _, at in self.model.pre_tokenizer.pre_tokenize_str(probe)]

    def odd_characters(self, texts: list[str]) -> list[str]:
        """The characters of the texts that the pattern and the library do not class alike."""
        known, out = self.classed, []
        for c in set().union(*texts):
            if c not in known:
                known[c] = c.isascii() and c.isalnum() or self._same_class(c)
            if not known[c]:
                out.append(c)
        return out

    def whole(self, text: str, odd: list[str]) -> bool:
        return any(c in text for c in odd) or any(s in text for s in self.others)

    def parts(self, text: str) -> tuple[list[str], int]:
        """What lies between special tokens, and how many of these there are."""
        if self.special is None or self.special not in text:
            return [text], 0
        parts = text.split(self.special)
        return parts, len(parts) - 1

    def lengths(self, words: list[str]) -> list[int]:
        coded = self.model.encode_batch_fast(words, add_special_tokens=False)
        return [len(e.ids) for e in coded]


_GAP = re.compile(r"(?<=\S)\s")


def pieces(text: str) -> Iterator[str]:
    """Cut a long text before white space after something else: no pre-token reaches across."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _GAP.search(text, at + _PIECE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def _checked(path: str) -> None:
    require(path.endswith(".json"), "token counts need a tokenizers file (.json)")
    with open(path, encoding="utf-8") as file:
        kinds = json.load(file)
    cut = kinds["pre_tokenizer"] or {}
    require(cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space") and kinds["normalizer"] is None
            and kinds["model"]["type"] == "BPE" and not kinds["model"].get("dropout"),
            "token counts need a byte-level merge vocabulary without a normalizer")


class Summary:
    """Counts of frequent words in bounded space; summaries merge in any order.

    Beyond four times ``most`` words, all counts are lowered by that of the first word that has to
    go: a word with more than its share of all counts is never lost.
    """

    def __init__(self, most: int):
        self.most, self.counts = most, Counter()

    def add(self, words, counts=None) -> None:
        if counts is None:
            self.counts.update(words)
        else:
            for word, n in zip(words, counts):
                self.counts[word] += n
        if len(self.counts) > 4 * self.most:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) <= self.most:
            return
        values = np.fromiter(self.counts.values(), dtype=np.int64, count=len(self.counts))
        low = int(np.partition(values, len(values) - self.most - 1)[len(values) - self.most - 1])
        self.counts = Counter({w: n - low for w, n in self.counts.items() if n > low})

    def batches(self, place: int) -> Iterator[pa.RecordBatch]:
        self.shrink()
        words = list(self.counts)
        for at in range(0, len(words), _SLICE):
            some = words[at:at + _SLICE]
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([some], pa.list_(pa.string())),
                 pa.array([[self.counts[w] for w in some]], pa.list_(pa.int64()))],
                names=["place", "words", "counts"])


def _texts(batch: pa.RecordBatch, name: str, rows: int = 256) -> Iterator[list[str]]:
    values = batch.column(name)
    for at in range(0, len(values), rows):
        yield [t or "" for t in values.slice(at, rows).to_pylist()]


def frequent_lengths(df: DataFrame, path: str, text: str = "text", frequent: int = 65_536
                     ) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of all texts, ``frequent`` at most, with their lengths."""
    _checked(path)
    places = partitions(df.sparkSession)
    schema = f"place int, {_SUMMARY}"

    def count(batches):
        from pyspark import TaskContext
        cut, seen = PreTokens(path), Summary(frequent)
        for batch in batches:
            for texts in _texts(batch, "text"):
                odd = cut.odd_characters(texts)
                for t in texts:
                    if not cut.whole(t, odd):
                        for part in cut.parts(t)[0]:
                            for piece in pieces(part):
                                seen.add(cut.find(piece))
        seen.counts = Counter({w: n for w, n in seen.counts.items() if len(w) <= _LONGEST})
        yield from seen.batches(TaskContext.get().partitionId() % places)

    def merge(after: int):
        def run(batches):
            from pyspark import TaskContext
            seen = Summary(frequent)
            for batch in batches:
                for row in batch.to_pylist():
                    seen.add(row["words"], row["counts"])
            yield from seen.batches(TaskContext.get().partitionId() % after)
        return run

    summaries = df.select(col(text).alias("text")).mapInArrow(count, schema)
    while True:  # a task merges those of so many others, until one is left
        after = -(-places // _FAN_IN)
        summaries = summaries.repartitionById(places, F.col("place")).mapInArrow(
            merge(after), schema)
        if places == 1:
            break
        places = after
    rows = summaries.collect()
    words = sorted({w for row in rows for w in row["words"]})
    return list(zip(words, PreTokens(path).lengths(words))) if words else []


def _digests(words: list[str]) -> np.ndarray:
    """128 bits for each word: a shared hash is out of the question at any size."""
    joined = b"".join([xxhash.xxh3_128_digest(w.encode(errors="surrogatepass")) for w in words])
    return np.frombuffer(joined, dtype="<u8").reshape(-1, 2)


class LengthTable:
    """Hash table from words to lengths: open addressing in three arrays, looked up for many words
    at once."""

    def __init__(self, lengths: list[tuple[str, int]]):
        slots = 2
        while slots < 2 * len(lengths):
            slots *= 2
        self.keys = np.zeros((slots, 2), dtype=np.uint64)
        self.lengths = np.zeros(slots, dtype=np.uint16)
        self.longest = 0  # steps that the longest search takes
        for key, (_, n) in zip(_digests([w for w, _ in lengths]), lengths):
            at, steps = int(key[0]) & (slots - 1), 1
            while self.lengths[at]:
                at, steps = (at + 1) & (slots - 1), steps + 1
            self.keys[at], self.lengths[at] = key, n
            self.longest = max(self.longest, steps)

    def find(self, words: list[str]) -> np.ndarray:
        """The length of each word, 0 for those that are not in the table."""
        out = np.zeros(len(words), dtype=np.int64)
        if not words:
            return out
        keys, mask = _digests(words), np.uint64(len(self.lengths) - 1)
        left, at = np.arange(len(words)), keys[:, 0] & mask
        for _ in range(self.longest):
            found = self.lengths[at]
            hit = (found > 0) & (self.keys[at] == keys[left]).all(axis=1)
            out[left[hit]] = found[hit]
            on = (found > 0) & ~hit  # an empty slot ends a search
            left, at = left[on], (at[on] + np.uint64(1)) & mask
            if not len(left):
                break
        return out


class Cache:
    """word -> length in bounded space: when the young half is full it becomes the old half."""

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def get(self, word: str) -> int | None:
        n = self.young.get(word)
        if n is None:
            n = self.old.get(word)
            if n is not None:
                self.put(word, n)
        return n

    def put(self, word: str, n: int) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        if len(word) <= _LONGEST:
            self.young[word] = n


class TokenCounter:
    """One for each task: counts the tokens of texts by table, cache and library."""

    def __init__(self, path: str, table: LengthTable, cache: int):
        self.cut, self.table, self.cache = PreTokens(path), table, Cache(cache)

    def _lengths(self, words: list[str]) -> np.ndarray:
        out = self.table.find(words)
        missing = []
        for i in np.flatnonzero(out == 0):
            n = self.cache.get(words[i])
            if n is None:
                missing.append(i)
            else:
                out[i] = n
        if missing:
            for i, n in zip(missing, self.cut.lengths([words[i] for i in missing])):
                self.cache.put(words[i], n)
                out[i] = n
        return out

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        odd = self.cut.odd_characters(texts)
        block, owners, sizes = [], [], []

        def look_up() -> None:
            if block:
                coded = pa.array(block, pa.large_string()).dictionary_encode()
                lengths = self._lengths(coded.dictionary.to_pylist())
                sums = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])
                ends = np.cumsum(sizes)
                for owner, n in zip(owners, sums[ends] - sums[ends - sizes]):
                    out[owner] += int(n)
            block.clear(), owners.clear(), sizes.clear()

        for i, text in enumerate(texts):
            if self.cut.whole(text, odd):
                out[i] = self.cut.lengths([text])[0]
                continue
            parts, out[i] = self.cut.parts(text)
            for part in parts:
                for piece in pieces(part):
                    found = self.cut.find(piece)
                    block += found
                    owners.append(i)
                    sizes.append(len(found))
                    if len(block) >= _BLOCK:
                        look_up()
        look_up()
        return out


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens",
                 lengths: list[tuple[str, int]] | None = None, cache: int = 400_000) -> DataFrame:
    """Add the number of tokens of each text under the vocabulary at ``path``.

    ``lengths`` is what ``frequent_lengths`` gives; it is found on the same texts if it is left out.
    A worker's cache holds ``cache`` pre-tokens at most.
    """
    _checked(path)
    check_columns(df, [text])
    require(into != text, "the counts need a column of their own")
    if lengths is None:
        lengths = frequent_lengths(df, path, text)
    shared = df.sparkSession.sparkContext.broadcast(LengthTable(lengths))
    kept = df.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.LongType())])

    def run(batches):
        counter = TokenCounter(path, shared.value, cache)
        for batch in batches:
            counts = [n for texts in _texts(batch, text, 1024) for n in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())],
                                             names=schema.names)
    return kept.mapInArrow(run, schema)


def judge_lengths(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit: whether a text has more tokens than ``limit``."""
    sized = df.withColumn("n_bytes", F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint"))
    return count_tokens(sized, path, text).withColumn("over_limit", F.col("n_tokens") > limit)
