"""Token ids in files compressed by a grammar (Re-Pair), with random access.

Documents are tokenized in ascending order of their id, in deterministic shards. A task fills a file
until it has ``file_tokens`` ids and then builds the file's grammar: in every round the most
frequent pairs of neighbouring symbols become nonterminals and are replaced from left to right,
until pairs are rare. No pair crosses the end of a document. A file stores its rules, the length
that each nonterminal expands to, and where each document's symbols start, so that one document, or
one range of its ids, is decoded without the rest.

Defined results: a null text counts as empty and has the end id only; a null id sorts first and
reads back as null; rows that repeat an id follow each other, ordered by a hash of their text.
Other columns are not written. An empty table gives no files and no rows. A document of more than
``file_tokens`` ids fills a file of its own.
"""

from __future__ import annotations

import itertools
import os
import string
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.files import ShardFiles, file_system, in_shards, range_shards, read_files, write_files
from millrace.llm.text import partitions
from millrace.util import col, require

_MAGIC = b"REPAIR01"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))  # odd multipliers
_BIN_BITS = 18
_TEXTS, _TOGETHER = 4000, 256  # texts of which words are found, and ids put together, at a time


# --- Tokens -----------------------------------------------------------------

_MARKS = string.punctuation  # ASCII marks; none of them is a letter or number


class _Words(dict):
    """word -> its ids as bytes, made when they are first asked for."""

    def __init__(self, owner: Tokenizer, older: dict):
        super().__init__()
        self.owner, self.older = owner, older

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.owner.ids_of(word)
        self[word] = found
        return found


_FORMATS = [f"<{n}I" for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)


class Tokenizer:
    """The tokenizers library behind a memory of words.

    The vocabulary drops white space before merging, so a text's ids are those of its words one
    after the other. Words are cut at blanks and line feeds only; the library sees to any other
    white space inside a word. Words of letters only go straight to the library's merges, with each
    character as the library normalizes it; marks after such a word are a token run of their own.
    Of the words, two generations are kept: when the younger is full, the older is forgotten.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        from tokenizers import Tokenizer as Library
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Library.from_file(path)
        self.most_words = most_words
        self.words = _Words(self, {})
        self.characters: dict[str, str | None] = {}
        self.plain_ascii = all(self._character(c) == c.lower() for c in string.ascii_letters)

    def _character(self, c: str) -> str | None:
        """What the merges see for a letter; None if it does not stay one run of letters."""
        if c not in self.characters:
            normal = self.library.normalizer.normalize_str(c)
            parts = self.library.pre_tokenizer.pre_tokenize_str(normal)
            alone = normal.isalpha() and len(parts) == 1 and unicodedata.is_normalized("NFC", c)
            self.characters[c] = parts[0][0] if alone else None
        return self.characters[c]

    def _letters(self, word: str) -> str | None:
        if word.isascii():
            return word.lower() if word.isalpha() and self.plain_ascii else None
        if not word.isalpha() or not unicodedata.is_normalized("NFC", word):
            return None
        seen = [self._character(c) for c in word]
        return None if None in seen else "".join(seen)

    def ids_of(self, word: str) -> bytes:
        if self.plain_ascii and word.isascii() and word.isalpha() and word.islower():
            return _packed([t.id for t in self.library.model.tokenize(word)])
        stem = word.rstrip(_MARKS)
        if stem:
            letters = self._letters(stem)
            if letters is not None and len(stem) < len(word):
                return self.words[stem] + self.words[word[len(stem):]]
            if letters is not None and letters != word and word.isascii():
                return self.words[letters]
            if letters is not None:
                return _packed([t.id for t in self.library.model.tokenize(letters)])
        return _packed(self.library.encode(word, add_special_tokens=False).ids)

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, stop): the ids of all words one after the other, and where those of each stop.

        Words of ASCII letters are asked for in small letters, and apart from the marks after them.
        """
        stem = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.and_(pc.ascii_is_alpha(stem), pc.and_(pc.string_is_ascii(stem), self.plain_ascii))
        parts = [pc.if_else(plain, pc.ascii_lower(stem), words),
                 pc.if_else(plain, pc.utf8_ltrim(words, characters=string.ascii_letters), "")]
        asked = pa.concat_arrays(parts).dictionary_encode()
        known = [*map(self.words.__getitem__, asked.dictionary.to_numpy(False))]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, stop = _one_after_another(
            np.frombuffer(b"".join(known), dtype="<u4"), np.cumsum(size),
            asked.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.reshape(-1))
        return ids, stop[1::2]

    def encode(self, texts: list[str | None] | pa.Array, end: int) -> list[np.ndarray]:
        """The ids of every text, then ``end``. What many of the texts hold is asked for once."""
        if len(self.words) > self.most_words:
            self.words.older = {}
            self.words = _Words(self, self.words)
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        ids, stop = self._found(words.dictionary)
        # The last one, the end, follows the words of each text.
        ids, stop = np.append(ids, np.uint32(end)), np.append(stop, len(ids) + 1)
        word, at = words.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out = []
        for lo in range(0, len(texts), _TOGETHER):
            ends = at[lo + 1:lo + 1 + _TOGETHER] - at[lo]
            found, past = _one_after_another(
                ids, stop, np.insert(word[at[lo]:at[lo] + ends[-1]], ends, len(stop) - 1))
            out += np.split(found, past[ends + np.arange(len(ends))][:-1])
        return out


def _one_after_another(ids: np.ndarray, stop: np.ndarray, wanted: np.ndarray
                       ) -> tuple[np.ndarray, np.ndarray]:
    """(ids, stop) of the wanted ones of the runs of ids that end at ``stop``."""
    size = np.diff(stop, prepend=0)
    many, at = size.take(wanted), np.cumsum(size.take(wanted))
    place = np.repeat(stop.take(wanted) - at, many)
    place += np.arange(len(place))
    return ids.take(place), at


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker, so that its cache outlives a task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


# --- The grammar ------------------------------------------------------------

_BLOCK = 1 << 15  # symbols hashed together, so that they stay in the cache
_SIFT, _SIFT_BITS = 3, 21  # after so many rounds rare pairs are left out, by so many bits of a hash


def _bins(left: np.ndarray, right: np.ndarray, bits: int = _BIN_BITS) -> np.ndarray:
    """A bin for each pair of symbols, by a hash of 32-bit arithmetic."""
    out = np.empty(len(left), dtype=np.intp)
    mixed, other = np.empty(_BLOCK, dtype=np.uint32), np.empty(_BLOCK, dtype=np.uint32)
    for at in range(0, len(left), _BLOCK):
        n = min(_BLOCK, len(left) - at)
        m, o = mixed[:n], other[:n]
        np.multiply(left[at:at + n], _MIX[0], out=m)
        np.multiply(right[at:at + n], _MIX[1], out=o)
        np.bitwise_xor(m, o, out=m)
        np.right_shift(m, np.uint32(15), out=o)
        np.bitwise_xor(m, o, out=m)
        np.multiply(m, _MIX[2], out=m)
        np.right_shift(m, np.uint32(32 - bits), out=m)
        out[at:at + n] = m
    return out


def _frequent_pairs(before: np.ndarray, after: np.ndarray, bins: np.ndarray, least: int, most: int
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent pairs, ascending, where pairs are that share their bins, and the pairs there.

    Frequent is what occurs as often as the ``most``-th fullest bin, and ``least`` times anyway.
    The counts of bins bound those of their pairs, so only pairs in the fullest bins are sorted. If
    full bins are made of rare pairs only, every pair that occurs ``least`` times is frequent.
    """
    in_bin = np.bincount(bins, minlength=1 << _BIN_BITS)
    for bar in (max(least, int(np.partition(in_bin, -most)[-most])), least):
        inside = np.flatnonzero((in_bin >= bar).take(bins))
        keys = np.empty((len(inside), 2), dtype="<u4")
        keys[:, 0], keys[:, 1] = after.take(inside), before.take(inside)
        keys = keys.view("<u8").reshape(-1)
        ordered = np.sort(keys)
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)])
        pairs = ordered[start[np.diff(start, append=len(ordered)) >= bar]]
        if len(pairs) or bar == least:
            break
    return pairs, inside, keys


def build_grammar(ids: np.ndarray, starts: np.ndarray, terminals: int,
                  rounds: int | None = None, pairs_per_round: int = 4096, least: int = 16):
    """(symbols, starts, left, right): the compressed symbols, where each document starts in them,
    and the two symbols of each rule. Rule i is symbol ``terminals`` + i. Without ``rounds`` it ends
    when no pair occurs ``least`` times."""
    symbols, starts = ids.astype(np.uint32), starts.astype(np.int64)
    left, right = [], []
    within = np.ones(len(symbols), dtype=bool)  # the next symbol is of the same document
    within[starts[starts > 0] - 1] = False
    within[-1:] = False
    # A pair that occurs too rarely never gets frequent: only pairs with a new symbol are new.
    live = within.copy()
    for turn in itertools.count() if rounds is None else range(rounds):
        at = np.flatnonzero(live)
        before, after = symbols.take(at), symbols.take(at + 1)
        if turn % _SIFT == 0:
            bins = _bins(before, after, _SIFT_BITS)
            held = np.flatnonzero((np.bincount(bins, minlength=1 << _SIFT_BITS) >= least).take(bins))
            live[:] = False
            at, before, after = at.take(held), before.take(held), after.take(held)
            live[at] = True
        bins = _bins(before, after)
        pairs, inside, keys = _frequent_pairs(before, after, bins, least, pairs_per_round)
        if not len(pairs):
            break
        # A bin names one pair; another pair of the same bin waits for the next round.
        own = _bins((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
        _, one = np.unique(own, return_index=True)
        pairs, own = pairs[np.sort(one)], own[np.sort(one)]
        rule_of = np.full(1 << _BIN_BITS, -1, dtype=np.int32)
        rule_of[own] = np.arange(len(pairs))
        rule = rule_of.take(bins.take(inside))
        hit = np.flatnonzero(rule >= 0)
        hit = hit[pairs.take(rule.take(hit)) == keys.take(hit)]
        at, rule = at.take(inside.take(hit)), rule.take(hit)
        # Overlapping occurrences stand next to each other: of each run take every second one.
        order = np.arange(len(at))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        run_start = np.maximum.accumulate(np.where(fresh, order, 0))
        taken = (order - run_start) % 2 == 0
        at, rule = at[taken], rule[taken]
        first = terminals + sum(map(len, left))
        left.append((pairs >> np.uint64(32)).astype(np.uint32))
        right.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        symbols[at] = (first + rule).astype(np.uint32)
        within[at] = within[at + 1]
        live[at] = within[at]
        ahead = at[at > 0] - 1
        live[ahead] = within[ahead]
        starts = starts - np.searchsorted(at + 1, starts, side="left")
        kept = np.ones(len(symbols), dtype=bool)
        kept[at + 1] = False
        symbols, within, live = symbols[kept], within[kept], live[kept]
    empty = np.zeros(0, dtype=np.uint32)
    return (symbols, starts, np.concatenate(left) if left else empty,
            np.concatenate(right) if right else empty)


def expansion_lengths(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for. A rule only names rules before it."""
    lengths = np.zeros(len(left), dtype=np.int64)
    known = np.zeros(len(left), dtype=bool)

    def of(symbols):
        rules = symbols.astype(np.int64) - terminals
        return np.where(rules < 0, 1, lengths[np.maximum(rules, 0)] if len(lengths) else 1)
    while not known.all():
        lengths_now = of(left) + of(right)
        ready = (lengths_now > 0) & _ready(left, known, terminals) & _ready(right, known, terminals)
        lengths[ready] = lengths_now[ready]
        known |= ready
    return lengths


def _ready(symbols: np.ndarray, known: np.ndarray, terminals: int) -> np.ndarray:
    rules = symbols.astype(np.int64) - terminals
    return (rules < 0) | known[np.maximum(rules, 0)]


def expansions(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, terminals: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): what every rule stands for, one after the other."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    ids = np.zeros(int(starts[-1]), dtype=np.uint32)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        at = int(starts[i])
        for symbol in (a, b):
            rule = symbol - terminals
            n = int(lengths[rule]) if rule >= 0 else 1
            ids[at:at + n] = ids[starts[rule]:starts[rule] + n] if rule >= 0 else symbol
            at += n
    return ids, starts


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray], terminals: int) -> np.ndarray:
    """The ids that symbols stand for; ``table`` is that of ``expansions``."""
    ids, starts = table
    rules = symbols.astype(np.int64) - terminals
    is_rule = rules >= 0
    if not is_rule.any():
        return symbols
    sizes = np.ones(len(symbols), dtype=np.int64)
    sizes[is_rule] = np.diff(starts)[rules[is_rule]]
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint32)
    out[at[~is_rule]] = symbols[~is_rule]
    n, first = sizes[is_rule], starts[rules[is_rule]]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at[is_rule], n) + inside] = ids[np.repeat(first, n) + inside]
    return out


# --- The file format --------------------------------------------------------
#
# Magic, then the numbers of terminals, rules, documents and symbols (8 bytes each), then arrays:
# left and right symbol of each rule and its length (4, 4, 8 bytes), document ids and whether they
# are known (8, 1), ids and symbols before each document (8, 8; one more than documents), and the
# symbols, 3 bytes each while they fit, else 4. All little-endian.

def pack(doc_ids: list, ids: list[np.ndarray], terminals: int, **options) -> bytes:
    """The bytes of a file for documents with their ids."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    symbols, places, left, right = build_grammar(
        np.concatenate(ids) if ids else np.zeros(0, np.uint32), starts, terminals, **options)
    width = 3 if terminals + len(left) < 1 << 24 else 4
    body = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    head = np.array([terminals, len(left), len(ids), len(symbols)], dtype="<u8")
    return b"".join([
        _MAGIC, head.tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(),
        expansion_lengths(left, right, terminals).astype("<u8").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype="u1").tobytes(),
        starts.astype("<u8").tobytes(), places.astype("<u8").tobytes(),
        np.ascontiguousarray(body).tobytes()])


class GrammarFile:
    """A packed file; documents are decoded one by one, or a range of their ids."""

    def __init__(self, data: bytes):
        require(data[:8] == _MAGIC, "not a grammar file")
        self.terminals, n_rules, n_docs, n_symbols = (
            int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40

        def take(kind: str, n: int):
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found
        self.left, self.right = take("<u4", n_rules), take("<u4", n_rules)
        self.lengths = take("<u8", n_rules).astype(np.int64)
        self.table = expansions(self.left, self.right, self.lengths, self.terminals)
        numbers, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.places = take("<u8", n_docs + 1).astype(np.int64)
        self.width = 3 if self.terminals + n_rules < 1 << 24 else 4
        self.raw = take("u1", n_symbols * self.width).reshape(-1, self.width)

    def symbols(self, first: int, last: int) -> np.ndarray:
        wide = np.zeros((last - first, 4), dtype=np.uint8)
        wide[:, :self.width] = self.raw[first:last]
        return wide.reshape(-1).view("<u4")

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols(self.places[i], self.places[i + 1]), self.table, self.terminals)

    def ids(self, i: int, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` of document i: only the symbols over that range are opened."""
        symbols = self.symbols(self.places[i], self.places[i + 1])
        rules = symbols.astype(np.int64) - self.terminals
        sizes = np.where(rules < 0, 1, self.lengths[np.maximum(rules, 0)] if len(self.lengths)
                         else 1)
        ends = np.cumsum(sizes)
        a = int(np.searchsorted(ends, first, side="right"))
        b = int(np.searchsorted(ends, last, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.table, self.terminals)[first - skipped:last - skipped]

    def documents(self, block: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, decoded in blocks of about ``block`` symbols."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.places, self.places[i] + block)) - 1)
            j = min(j, n)
            ids = expand(self.symbols(self.places[i], self.places[j]), self.table, self.terminals)
            cuts = self.starts[i:j + 1] - self.starts[i]
            for d in range(i, j):
                yield d, ids[cuts[d - i]:cuts[d - i + 1]]
            i = j


# --- Writing and reading on the cluster -------------------------------------

DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, part int"
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("part", pa.int32())])


def _writer(path: str, end: int, file_tokens: int, options: dict) -> Callable:
    def at(root: str):
        def write(batches):
            files, coder = ShardFiles(root, ".repair"), tokenizer(path)
            terminals = coder.library.get_vocab_size()
            shard, part, doc_ids, ids, held = None, 0, [], [], 0

            def flush():
                nonlocal part, doc_ids, ids, held
                if doc_ids:
                    files.open(shard, part)
                    files.write(pack(doc_ids, ids, terminals, **options), len(doc_ids), held)
                    files.close()
                    part += 1
                doc_ids, ids, held = [], [], 0

            for batch in batches:
                shards = batch.column("_shard").to_pylist()
                known = batch.column("id").to_pylist()
                for lo in range(0, len(known), _TEXTS):
                    texts = batch.column("text").slice(lo, _TEXTS)
                    for i, found in enumerate(coder.encode(texts, end), lo):
                        if shards[i] != shard:
                            flush()
                            shard, part = shards[i], 0
                        doc_ids.append(known[i])
                        ids.append(found)
                        held += len(found)
                        if held >= file_tokens:
                            flush()
            flush()
            yield from files.report()
        return write
    return at


def write_tokens(df: DataFrame, root: str, tokenizer_path: str, identifier: str = "doc_id",
                 text: str = "text", end: int = 2, shards: int | None = None,
                 file_tokens: int = 4 << 20, **options) -> DataFrame:
    """Encode all texts into grammar files below ``root``; return the manifest.

    Options go to ``build_grammar``: rounds, pairs_per_round, least.
    """
    spark = df.sparkSession
    shards = shards or partitions(spark)
    slim = df.select(col(identifier).alias("id"), col(text).alias("text"))
    placed, _ = range_shards(slim, "id", shards)
    ordered = in_shards(placed, shards, F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return write_files(spark, root, ordered, _writer(tokenizer_path, end, file_tokens, options))


def _reader(root: str) -> Callable:
    def read(batches):
        system, base = file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{base}/{row['name']}") as stream:
                    file = GrammarFile(stream.read())
                out = []
                for i, ids in file.documents():
                    out.append({
                        "doc_id": file.doc_ids[i], "start": row["before"] + int(file.starts[i]),
                        "n_tokens": len(ids), "shard": row["shard"], "part": row["part"],
                        "ids_crc32": zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))})
                yield pa.RecordBatch.from_pylist(out, schema=_DOCUMENTS)
    return read


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """One row per document of the published files: where its ids start, how many, their CRC."""
    return read_files(spark, root, _reader, DOCUMENTS)
