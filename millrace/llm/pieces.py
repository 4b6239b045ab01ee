"""SentencePiece encoding and decoding, in parallel inside giant documents too.

The vocabulary is that of a model file. A text's encoding is the sequence of pieces with the highest
sum of scores (the unigram rule). In max-plus arithmetic a stretch of text is a matrix: entry (i, j)
is the best score of a path that begins i characters after the stretch's start, because a piece from
the stretch before reaches that far, and ends j characters after its end. Matrices of neighbouring
stretches combine associatively.

A document of more than ``giant`` characters is cut into chunks at fixed places:
1. every chunk yields its matrix;
2. blocks of chunks are multiplied, the blocks scanned, and each chunk gets the scores of its
   entry states;
3. every chunk tells which entry state each exit state comes from, and these small maps are composed
   from the end;
4. every chunk, now knowing its exit state, is traced back on its own.
Scores are whole numbers (fixed point), so sums are exact and the result does not depend on where the
chunks are cut. Ties go to the longest last piece.

Where no piece of the vocabulary has a blank after another character, words can be encoded one by
one, which is the same result and lets a worker remember words. The words of a batch that it does not
know yet are segmented together, place by place, over a trie held in arrays.

Defined results: a null text counts as empty and has no pieces; characters that no piece covers
become byte pieces, or the unknown piece if the model has no bytes. Decoding restores the normalized
text; the character U+2581 reads back as a blank. Rows are treated one by one, so repeated rows get
equal results, and a giant row is known by the place where it was read, not by its id. All columns
are kept; a column with the name of the result is replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import partitions
from millrace.util import col, fresh, require, written

BLANK = "▁"
_IMPOSSIBLE = -(1 << 60)
_SCALE = 1 << 20  # scores that are not whole numbers are kept to a millionth
_SHORT = 48  # words up to this length are segmented together
_TOGETHER = 8192  # so many of them at once
_WORD = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class PieceTrie:
    """The beginnings of all pieces as nodes; steps from node to node are one hash table of arrays."""

    _EMPTY, _FACTOR = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)  # fixed values

    def __init__(self, beginnings: dict[str, int | None], ids: dict[str, int]):
        prefixes = sorted(beginnings, key=len)
        node = {"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        characters = sorted({p[-1] for p in prefixes})
        self.kinds = np.zeros(0x110000, np.uint64)  # 0: in no piece
        self.kinds[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.width = np.uint64(len(characters) + 1)
        scores = (beginnings[p] for p in prefixes)
        self.scores = np.array([_IMPOSSIBLE, *(_IMPOSSIBLE if s is None else s for s in scores)])
        self.ids = np.array([-1, *(ids.get(p, -1) for p in prefixes)], np.int32)
        steps = (np.array([node[p[:-1]] for p in prefixes], np.uint64) * self.width
                 + self.kinds[[ord(p[-1]) for p in prefixes]])
        bits = max(10, len(prefixes).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.steps = np.full((1 << bits) + len(prefixes), self._EMPTY)
        self.nodes = np.zeros(len(self.steps), np.int32)
        left, slot = np.arange(len(steps)), self._slots(steps)
        while len(left):
            free = self.steps[slot] == self._EMPTY
            _, one = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[one]
            self.steps[slot[chosen]] = steps[left[chosen]]
            self.nodes[slot[chosen]] = left[chosen] + 1
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], slot[rest] + 1

    def _slots(self, steps: np.ndarray) -> np.ndarray:
        return ((steps * self._FACTOR) >> self.shift).astype(np.int64)

    def go(self, nodes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The node after each of ``nodes`` by a character of each kind; 0 where there is none."""
        steps = nodes.astype(np.uint64) * self.width + kinds
        slot = self._slots(steps)
        seen = self.steps[slot]
        out = np.where(seen == steps, self.nodes[slot], 0)
        open_ = np.flatnonzero((seen != steps) & (seen != self._EMPTY))
        slot = slot[open_]
        while len(open_):
            slot = slot + 1
            seen, wanted = self.steps[slot], steps[open_]
            hit = seen == wanted
            out[open_[hit]] = self.nodes[slot[hit]]
            on = ~hit & (seen != self._EMPTY)
            open_, slot = open_[on], slot[on]
        return out


class Vocabulary:
    """The pieces of a model file and the best segmentations over them."""

    def __init__(self, path: str, most_words: int = 250_000):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (
            self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
            or self.model.is_unused(i))]
        names = {i: self.model.id_to_piece(i) for i in range(n)}
        scores = {i: float(self.model.get_score(i)) for i in plain}
        scale = 1 if all(s == int(s) for s in scores.values()) else _SCALE
        self.scores = {names[i]: round(s * scale) for i, s in scores.items()}
        self.ids = {names[i]: i for i in plain}
        # Fixed value of the unigram rule: an uncovered character scores 10 below the worst piece.
        self.unknown_score = min(self.scores.values()) - 10 * scale
        # Every beginning of a piece, with the score of the piece that it is itself, if it is one.
        self.beginnings = {p[:k]: None for p in self.ids for k in range(1, len(p))} | self.scores
        self.neighbours = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.trie = PieceTrie(self.beginnings, self.ids)
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        self.unknown = self.model.unk_id()
        self.surface = [bytes([int(names[i][1:-1], 16)]) if self.model.is_byte(i)
                        else b"" if self.model.is_control(i) else names[i].encode()
                        for i in range(n)]
        self.by_words = not any(BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1)
                                for p in self.ids)
        # Two generations of words: when the younger is full, the older is forgotten.
        self.most_words = most_words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalize(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    def edges(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, score) of every piece that begins at ``start``, the shortest first."""
        single = False
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            score = self.beginnings.get(text[start:end], False)
            if score is False:
                break
            if score is not None:
                single |= end == start + 1
                yield end, score
        if not single:
            yield start + 1, self.unknown_score

    def forward(self, text: str, entry: dict[int, int], size: int) -> tuple[list, list]:
        """Best score at each place, and where the last piece of the best path begins.

        ``entry`` has the scores of the places to begin at; pieces begin before ``size`` and may
        end after it.
        """
        best, back = [None] * (len(text) + 1), [-1] * (len(text) + 1)
        for place, score in entry.items():
            best[place] = score
        for start in range(size):
            if best[start] is None:
                continue
            for end, score in self.edges(text, start):
                total = best[start] + score
                if best[end] is None or total > best[end]:
                    best[end], back[end] = total, start
        return best, back

    def trace(self, back: list, end: int) -> list[int]:
        """The places between the pieces of the best path to ``end``, from its beginning on."""
        places = [end]
        while back[places[-1]] >= 0:
            places.append(back[places[-1]])
        return places[::-1]

    def spell(self, text: str, places: list[int]) -> list[int]:
        out: list[int] = []
        was_unknown = False
        for a, b in zip(places, places[1:]):
            found = self.ids.get(text[a:b])
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[x] for x in text[a:b].encode())
            elif not was_unknown:
                out.append(self.unknown)
            was_unknown = found is None
        return out

    def encode(self, normal: str) -> bytes:
        """The ids of a normalized text, as little-endian 32-bit numbers."""
        return self.encode_all([normal])[0]

    def encode_all(self, normals: list[str]) -> list[bytes]:
        if not self.by_words:
            return [self._segment(n) for n in normals]
        if len(self.words) > self.most_words:
            self.words, self.older = {}, self.words
        texts = [_WORD.findall(n) for n in normals]
        self._learn(set().union(*texts))
        known = self.words
        return [b"".join(map(known.__getitem__, parts)) for parts in texts]

    def _learn(self, wanted: set[str]) -> None:
        """Know these words: the short ones together, long ones by their units."""
        known, older = self.words, self.older
        short, long = [], []
        for word in wanted.difference(known):
            found = older.get(word)
            if found is not None:
                known[word] = found
            else:
                (short if len(word) <= _SHORT else long).append(word)
        units = {word: self._units(word) for word in long}
        parts = {u for us in units.values() for u in us if len(u) <= _SHORT}
        short += parts.difference(known, short)
        short.sort(key=len)
        for at in range(0, len(short), _TOGETHER):
            some = short[at:at + _TOGETHER]
            known.update(zip(some, self.segment_all(some)))
        for word, us in units.items():
            known[word] = b"".join(known[u] if u in known else self._unit(u) for u in us)

    def segment_all(self, words: list[str]) -> list[bytes]:
        """``_segment`` of many words (none is empty), all of them place by place."""
        sizes = np.array([len(w) for w in words])
        n, count = int(sizes.max()), len(words)
        column = np.repeat(np.arange(count), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = np.zeros((n, count), np.uint64)
        kinds[place, column] = self.trie.kinds[codes]
        best = np.full((n + 1, count), _IMPOSSIBLE, np.int64)
        best[0] = 0
        back = np.zeros((n + 1, count), np.int16)
        piece = np.full((n + 1, count), -1, np.int32)
        for start in range(n):
            at = np.flatnonzero(sizes > start)
            alone, nodes = np.ones(count, bool), np.zeros(len(at), np.int32)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                nodes = self.trie.go(nodes, kinds[end - 1, at])
                goes_on = nodes > 0
                at, nodes = at[goes_on], nodes[goes_on]
                if not len(at):
                    break
                scores = self.trie.scores[nodes]
                total = best[start, at] + scores
                better = (scores > _IMPOSSIBLE) & (total > best[end, at])
                gains = at[better]
                best[end, gains], back[end, gains] = total[better], start
                piece[end, gains] = self.trie.ids[nodes[better]]
                if end == start + 1:
                    alone[at[scores > _IMPOSSIBLE]] = False
            total = best[start] + self.unknown_score
            gains = np.flatnonzero(alone & (sizes > start) & (total > best[start + 1]))
            best[start + 1, gains], back[start + 1, gains] = total[gains], start
            piece[start + 1, gains] = -1
        # From the ends on, one piece of every word at a time.
        found, of, uncovered = [], [], np.zeros(count, bool)
        at, ends = np.arange(count), sizes
        while len(at):
            last = piece[ends, at]
            uncovered[at[last < 0]] = True
            found.append(last)
            of.append(at)
            ends = back[ends, at].astype(np.int64)
            at, ends = at[ends > 0], ends[ends > 0]
        order = np.argsort(np.concatenate(of[::-1]), kind="stable")
        ids = np.concatenate(found[::-1])[order].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.bincount(np.concatenate(of), minlength=count))
        out = [ids[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        for i in np.flatnonzero(uncovered).tolist():
            spelled = self.spell(words[i], self.trace(
                [-1, *back[1:sizes[i] + 1, i].tolist()], int(sizes[i])))
            out[i] = struct.pack(f"<{len(spelled)}I", *spelled)
        return out

    def _units(self, word: str) -> list[str]:
        """The word cut where no piece has these two characters side by side."""
        if word.lstrip(BLANK).isalnum():
            return [word]  # cuts only save time, and few are found inside letters
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in self.neighbours:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def _unit(self, text: str) -> bytes:
        found = self.words.get(text) or self.older.get(text)
        if found is None:
            found = self.words[text] = self._segment(text)
        return found

    def _segment(self, text: str) -> bytes:
        """``forward`` from the first place, without what only chunks need."""
        n, longest, beginnings, unknown = (
            len(text), self.longest, self.beginnings.get, self.unknown_score)
        best, back = [0] + [None] * n, [-1] * (n + 1)
        for start in range(n):
            so_far, single = best[start], False
            for end in range(start + 1, min(n, start + longest) + 1):
                score = beginnings(text[start:end], False)
                if score is False:
                    break
                if score is not None:
                    single = single or end == start + 1
                    if best[end] is None or so_far + score > best[end]:
                        best[end], back[end] = so_far + score, start
            if not single and (best[start + 1] is None or so_far + unknown > best[start + 1]):
                best[start + 1], back[start + 1] = so_far + unknown, start
        found, end = [], n
        while end:
            piece = self.ids.get(text[back[end]:end])
            if piece is None:
                found = self.spell(text, self.trace(back, n))[::-1]
                break
            found.append(piece)
            end = back[end]
        return struct.pack(f"<{len(found)}I", *found[::-1])

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode(errors="replace").replace(BLANK, " ").removeprefix(" ")

    # --- chunks -------------------------------------------------------------

    def word_breaks(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and last place of a chunk that no piece can span, behind all entry states."""
        if not self.by_words:
            return None
        breaks = [m.start() for m in _WORD.finditer(text)
                  if self.longest <= m.start() <= size]
        breaks = [b for b in breaks if b > 0 and _is_break(text, b)]
        return (breaks[0], breaks[-1]) if breaks else None

    def matrix(self, text: str, size: int, first: bool, last: bool) -> np.ndarray:
        """Max-plus matrix of a chunk: ``size`` characters, and what follows for straddling pieces."""
        n = self.longest
        out = np.full((n, n), _IMPOSSIBLE, dtype=np.int64)
        entries = [0] if first else range(min(n, size + 1))
        breaks = self.word_breaks(text, size)
        if breaks is None:
            for i in entries:
                best, _ = self.forward(text, {i: 0}, size)
                self._exits(out[i], best, size, last)
            return out
        a, b = breaks
        middle, _ = self.forward(text[a:b], {0: 0}, b - a)
        tail, _ = self.forward(text[b:], {0: 0}, size - b)
        row = np.full(n, _IMPOSSIBLE, dtype=np.int64)
        self._exits(row, tail, size - b, last)
        for i in entries:
            head, _ = self.forward(text[:a], {i: 0}, a)
            if head[a] is not None:
                out[i] = np.where(row > _IMPOSSIBLE, row + head[a] + middle[-1], _IMPOSSIBLE)
        return out

    def _exits(self, row: np.ndarray, best: list, size: int, last: bool) -> None:
        for j in range(1 if last else len(row)):
            if size + j < len(best) and best[size + j] is not None:
                row[j] = best[size + j]

    def trace_chunk(self, text: str, size: int, entry: dict[int, int], exits
                    ) -> dict[int, tuple[int, list[int]]]:
        """For each exit state: the entry state of the best path to it, and the path's ids."""
        best, back = self.forward(text, entry, size)
        found = {}
        for j in exits:
            if size + j < len(best) and best[size + j] is not None:
                places = self.trace(back, size + j)
                found[j] = places[0], self.spell(text, places)
        return found


def _is_break(text: str, place: int) -> bool:
    before, after = text[place - 1], text[place]
    return before == "\n" or after == "\n" or (before != BLANK and after == BLANK)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker, so that the words it remembers outlive a task."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; impossible stays impossible."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.maximum(out, _IMPOSSIBLE)


def _step(entry: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Entry scores of the next chunk, lowered so that the best is zero: only differences count."""
    out = np.maximum((entry[:, None] + matrix).max(axis=0), _IMPOSSIBLE)
    return np.where(out > _IMPOSSIBLE // 2, out - out.max(), _IMPOSSIBLE)


# --- On the cluster ---------------------------------------------------------

def _batches(frame: DataFrame, function, schema: T.StructType) -> DataFrame:
    """mapInArrow over batches as lists of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = function(batch.slice(at, 512).to_pylist())
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
    return frame.mapInArrow(run, schema)


def _add(frame: DataFrame, source: str, *made: tuple) -> DataFrame:
    """Add columns (name, type, function), the first made from ``source``, each other from the one
    before it. A function takes and returns a list of values."""
    schema = T.StructType([*frame.schema.fields, *[T.StructField(n, t) for n, t, _ in made]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                columns, values = list(batch.columns), batch.column(source).to_pylist()
                for _, kind, function in made:
                    values = function(values)
                    columns.append(pa.array(values, pa.binary() if isinstance(kind, T.BinaryType)
                                            else pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return frame.mapInArrow(run, schema)


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def encode(df: DataFrame, model_path: str, text: str = "text", into: str = "ids",
           decoded: str | None = None, giant: int = 65_536, chunk: int = 16_384,
           block: int = 64) -> DataFrame:
    """Add the ids of each text as a binary column of little-endian 32-bit numbers.

    With ``decoded``, also add the text that the ids decode to, in the same pass.
    """
    require(chunk > 0 and block > 0 and giant >= chunk, "chunks are smaller than giants")
    added = [into] + ([decoded] if decoded else [])
    kept = df.drop(*[c for c in added if c in df.columns])
    size = F.coalesce(F.length(col(text)), F.lit(0))

    def whole(values: list[str | None]) -> list[bytes]:
        v = vocabulary(model_path)
        return v.encode_all([v.normalize(x or "") for x in values])

    made = [(into, T.BinaryType(), whole)] + ([_decoding(model_path, decoded)] if decoded else [])
    small = _add(kept.where(size <= giant), text, *made)
    place = fresh(kept, "_place")
    giants = kept.where(size > giant).withColumn(place, F.monotonically_increasing_id())
    giants = written(giants, "giants")  # the place is fixed from here on
    ids = _encode_giants(giants.select(col(place).alias("place"), col(text).alias("text")),
                         model_path, chunk, block)
    held = fresh(kept, "_ids")
    found = giants.join(ids.toDF(place, held), place).select(
        *[col(c) for c in kept.columns], F.col(held).alias(into))
    return small.unionByName(decode(found, model_path, into, decoded) if decoded else found)


def _encode_giants(giants: DataFrame, path: str, chunk: int, block: int) -> DataFrame:
    def cut(rows):
        v = vocabulary(path)
        out = []
        for r in rows:
            normal = v.normalize(r["text"])
            for number, at in enumerate(range(0, len(normal), chunk)):
                out.append({
                    "place": r["place"], "chunk": number, "block": number // block,
                    "size": min(chunk, len(normal) - at), "last": at + chunk >= len(normal),
                    "piece": normal[at:at + chunk + v.longest - 1]})
        return out

    chunks = written(_batches(giants.repartition(partitions(giants.sparkSession)), cut, _schema(
        "place long, chunk int, block int, size int, last boolean, piece string")), "chunks")
    chunks = chunks.repartition(partitions(giants.sparkSession), "place", "chunk")
    key = "place long, chunk int, block int"

    def matrices(rows):
        v = vocabulary(path)
        return [{**{k: r[k] for k in ("place", "chunk", "block")},
                 "matrix": v.matrix(r["piece"], r["size"], r["chunk"] == 0, r["last"]).tobytes()}
                for r in rows]

    local = written(_batches(chunks, matrices, _schema(f"{key}, matrix binary")), "matrices")

    def square(data: bytes) -> np.ndarray:
        flat = np.frombuffer(data, dtype=np.int64)
        return flat.reshape(int(len(flat) ** 0.5), -1)

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [square(m) for m in frame.sort_values("chunk")["matrix"]]
        total = parts[0]
        for part in parts[1:]:
            total = combine(total, part)
        return pd.DataFrame({"place": [frame["place"].iloc[0]], "block": [frame["block"].iloc[0]],
                             "matrix": [total.tobytes()]})

    def scan(frame: pd.DataFrame, by: str, entry: np.ndarray | None) -> pd.DataFrame:
        frame = frame.sort_values(by)
        entries = []
        for data in frame["matrix"]:
            m = square(data)
            if entry is None:
                entry = np.full(len(m), _IMPOSSIBLE, dtype=np.int64)
                entry[0] = 0
            entries.append(entry.tobytes())
            entry = _step(entry, m)
        return frame[["place", by]].assign(entry=entries)

    blocks = local.groupBy("place", "block").applyInPandas(
        product, "place long, block int, matrix binary")
    starts = blocks.groupBy("place").applyInPandas(
        lambda f: scan(f, "block", None), "place long, block int, entry binary")

    def inside(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return scan(left, "chunk", np.frombuffer(right["entry"].iloc[0], dtype=np.int64))

    entries = local.groupBy("place", "block").cogroup(
        starts.groupBy("place", "block")).applyInPandas(
        inside, "place long, chunk int, entry binary")
    ready = written(chunks.join(entries, ["place", "chunk"]), "chunk-entries")

    def possible(data: bytes) -> dict[int, int]:
        return {i: int(s) for i, s in enumerate(np.frombuffer(data, dtype=np.int64))
                if s > _IMPOSSIBLE // 2}

    def origins(rows):
        v = vocabulary(path)
        out = []
        for r in rows:
            found = v.trace_chunk(r["piece"], r["size"], possible(r["entry"]),
                                  [0] if r["last"] else range(v.longest))
            out.append({"place": r["place"], "chunk": r["chunk"],
                        "origin": [found[j][0] if j in found else -1 for j in range(v.longest)]})
        return out

    maps = _batches(ready, origins, _schema("place long, chunk int, origin array<int>"))

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", ascending=False)
        state, states = 0, []
        for origin in frame["origin"]:
            states.append(state)
            state = int(origin[state])
        return frame[["place", "chunk"]].assign(exit=states)

    leaving = maps.groupBy("place").applyInPandas(exits, "place long, chunk int, exit int")

    def spelled(rows):
        v = vocabulary(path)
        return [{"place": r["place"], "chunk": r["chunk"], "part": np.array(
            v.trace_chunk(r["piece"], r["size"], possible(r["entry"]), [r["exit"]])[r["exit"]][1],
            "<u4").tobytes()} for r in rows]

    parts = _batches(ready.join(leaving, ["place", "chunk"]), spelled,
                     _schema("place long, chunk int, part binary"))
    # One text's ids are one value of the result, as its characters were.
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "part")))
    return parts.groupBy("place").agg(in_order.alias("parts")).select("place", F.aggregate(
        "parts", F.lit(b""), lambda joined, p: F.concat(joined, p["part"])).alias("_ids"))


def decode(df: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; null ids give an empty text."""
    kept = df.drop(into) if into in df.columns else df
    return _add(kept, ids, _decoding(model_path, into))


def _decoding(model_path: str, into: str) -> tuple:
    def read(values: list[bytes | None]) -> list[str]:
        v = vocabulary(model_path)
        return [v.decode(ids or b"") for ids in values]
    return into, T.StringType(), read
