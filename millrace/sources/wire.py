"""The wire format of records on whole buffers: many messages are coded at once, as columns.

A record is a message of nested, length-prefixed fields. To write, every column becomes a tree of
``Piece`` objects that know the size of their part of each record and then fill it into one buffer.
To read, the fields of all messages of one level are found in step: the first field of every message,
then the second of those that have one, and so on; the numbers inside packed lists are all told apart
at once by their continuation bits. Values go to Arrow buffers without a Python object in between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from millrace.util import require

# Field numbers of the three kinds of feature.
BYTES, FLOATS, INTS = 1, 2, 3
PADDING = 16   # bytes behind the data, so that a number may be read at its very end
_FEW = 24      # with fewer messages than this, fields are read one by one


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all bytes of the given stretches, one stretch after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(starts - before, sizes)


def sums(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def leaf(kind: T.DataType) -> T.DataType:
    return leaf(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def depth(kind: T.DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def feature_kind(kind: T.DataType) -> int:
    if isinstance(kind, T.StringType):
        return BYTES
    return FLOATS if isinstance(kind, T.FloatType) else INTS


# --- Writing ----------------------------------------------------------------

class Piece:
    """A part of many messages: its ``size`` in each, and how it is filled in ``at`` positions."""

    size: np.ndarray

    def fill(self, out: np.ndarray, at: np.ndarray) -> None:
        raise NotImplementedError


class Fixed(Piece):
    """The same bytes in every message."""

    def __init__(self, data: bytes, n: int):
        self.data, self.size = data, np.full(n, len(data), dtype=np.int64)

    def fill(self, out, at):
        for i, byte in enumerate(self.data):
            out[at + i] = byte


class Varints(Piece):
    """One whole number each, seven bits a byte."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        self.size = np.ones(len(values), dtype=np.int64)
        rest = self.values >> np.uint64(7)
        while rest.any():
            self.size += rest > 0
            rest >>= np.uint64(7)

    def fill(self, out, at):
        rest, left = self.values, self.size
        while len(rest):
            more = left > 1
            out[at] = (rest & np.uint64(0x7F)).astype(np.uint8) | (more.astype(np.uint8) << 7)
            rest, left, at = rest[more] >> np.uint64(7), left[more] - 1, at[more] + 1


class Bytes(Piece):
    """A stretch of ``data`` each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.size = data, starts, sizes.astype(np.int64)

    def fill(self, out, at):
        out[flat(at, self.size)] = self.data[flat(self.starts, self.size)]


class Joined(Piece):
    """Pieces one after the other."""

    def __init__(self, pieces: list[Piece], n: int):
        self.pieces = pieces
        self.size = sum((p.size for p in pieces), np.zeros(n, dtype=np.int64))

    def fill(self, out, at):
        for piece in self.pieces:
            piece.fill(out, at)
            at = at + piece.size


class Many(Piece):
    """The items of ``piece`` from ``offsets[i]`` to ``offsets[i + 1]`` make up message i."""

    def __init__(self, piece: Piece, offsets: np.ndarray):
        self.piece, self.offsets, self.before = piece, offsets, sums(piece.size)
        self.size = self.before[offsets[1:]] - self.before[offsets[:-1]]

    def fill(self, out, at):
        counts = np.diff(self.offsets)
        inside = self.before[:-1] - np.repeat(self.before[self.offsets[:-1]], counts)
        self.piece.fill(out, np.repeat(at, counts) + inside)


class Where(Piece):
    """``piece`` in the messages marked ``valid``, nothing in the others."""

    def __init__(self, piece: Piece, valid: np.ndarray):
        self.piece, self.valid = piece, valid
        self.size = np.zeros(len(valid), dtype=np.int64)
        self.size[valid] = piece.size

    def fill(self, out, at):
        self.piece.fill(out, at[self.valid])


def field(number: int, piece: Piece) -> Piece:
    """A length-prefixed field with the given content."""
    n = len(piece.size)
    return Joined([Fixed(bytes([number << 3 | 2]), n), Varints(piece.size), piece], n)


def _lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The offsets and the values of lists without a null."""
    require(array.null_count == 0, "a list in a record cannot hold NULL")
    sizes = array.value_lengths().to_numpy(zero_copy_only=False)
    return sums(sizes), array.flatten()


def _feature(values: pa.Array, offsets: np.ndarray, kind: T.DataType) -> Piece:
    """One feature for each stretch of the values."""
    require(values.null_count == 0, "a list in a record cannot hold NULL")
    number = feature_kind(kind)
    if number == BYTES:
        text = values.cast(pa.large_string())
        _, places, data = text.buffers()
        ends = (np.frombuffer(places, dtype=np.int64)[text.offset:text.offset + len(text) + 1]
                if len(text) else np.zeros(1, dtype=np.int64))
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(
            0, dtype=np.uint8)
        return field(BYTES, Many(field(1, Bytes(raw, ends[:-1], np.diff(ends))), offsets))
    if number == FLOATS:
        raw = values.to_numpy(zero_copy_only=False).astype("<f4").view(np.uint8)
        return field(FLOATS, field(1, Bytes(raw, 4 * offsets[:-1], 4 * np.diff(offsets))))
    whole = values.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
    return field(INTS, field(1, Many(Varints(whole), offsets)))


def _entry(array: pa.Array, name: str, kind: T.DataType) -> Piece:
    """The map entry of one column in every record; nothing for NULL."""
    valid = array.is_valid().to_numpy(zero_copy_only=False)
    known, levels = array.drop_null(), depth(kind)
    if levels == 0:
        value = _feature(known, np.arange(len(known) + 1), leaf(kind))
    elif levels == 1:
        offsets, values = _lists(known)
        value = _feature(values, offsets, leaf(kind))
    else:
        outer, inner = _lists(known)
        offsets, values = _lists(inner)
        value = Many(field(1, _feature(values, offsets, leaf(kind))), outer)
    n, key = len(known), name.encode()
    named = Joined([Fixed(b"\x0a", n), Varints(np.full(n, len(key))), Fixed(key, n), field(2, value)], n)
    return Where(field(1, named), valid)


def messages(batch: pa.RecordBatch, schema: T.StructType, record_type: str) -> Piece:
    """The rows of a batch as messages. Lists of lists go to the feature lists."""
    n, single, lists = batch.num_rows, [], []
    for i, f in enumerate(schema):
        column = _entry(batch.column(i), f.name, f.dataType)
        (single if depth(f.dataType) < 2 else lists).append(column)
    head = field(1, Joined(single, n))
    return head if record_type == "Example" else Joined([head, field(2, Joined(lists, n))], n)


# --- Reading ----------------------------------------------------------------

def varints_at(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number that begins at each position, and the position behind it."""
    byte = data[at]
    value, end = (byte & 0x7F).astype(np.uint64), at + 1
    more, shift = np.flatnonzero(byte >= 0x80), 7
    while len(more):
        require(shift < 70, "a number in a record is too long")
        byte = data[end[more]]
        value[more] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
        end[more] += 1
        more, shift = more[byte >= 0x80], shift + 7
    return value, end


class Fields:
    """Fields of many messages: which message, number, wire type, and where the content lies."""

    def __init__(self, owner, number, wire, start, end):
        self.owner, self.number, self.wire = owner, number, wire
        self.start, self.end = start, end

    def __getitem__(self, at) -> Fields:
        return Fields(self.owner[at], self.number[at], self.wire[at], self.start[at], self.end[at])

    def __len__(self) -> int:
        return len(self.owner)


def _content(data, at):
    """Number, wire type, and the content's place of the field that begins at each position."""
    key, start = varints_at(data, at)
    number, wire = (key >> np.uint64(3)).astype(np.int64), (key & np.uint64(7)).astype(np.int64)
    size, behind = varints_at(data, start)
    long, eight = wire == 2, wire == 1
    require(bool(np.isin(wire, (0, 1, 2, 5)).all()), "unexpected wire type in a record")
    end = np.where(long, behind + size.astype(np.int64), np.where(
        wire == 0, behind, start + np.where(eight, 8, 4)))
    return number, wire, np.where(long, behind, start), end


def _one_by_one(data: memoryview, at: int, end: int, owner: int) -> list[tuple]:
    """The same for one message, for long messages that few others keep pace with."""
    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at += 1
            if byte < 0x80:
                return value, at
            shift += 7
    out = []
    while at < end:
        key, start = varint(at)
        wire = key & 7
        if wire == 2:
            size, start = varint(start)
            at = start + size
        elif wire == 0:
            _, at = varint(start)
        else:
            require(wire in (1, 5), "unexpected wire type in a record")
            at = start + (8 if wire == 1 else 4)
        out.append((owner, key >> 3, wire, start, at))
    require(at == end, "a field reaches beyond its message")
    return out


def fields(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Fields:
    """All fields of the messages that lie between the positions, message by message."""
    owner = np.flatnonzero(starts < ends)
    at, found, rest = starts[owner], [], []
    while len(owner) >= _FEW:
        number, wire, start, end = _content(data, at)
        require(bool((end <= ends[owner]).all()), "a field reaches beyond its message")
        found.append((owner, number, wire, start, end))
        on = end < ends[owner]
        owner, at = owner[on], end[on]
    if len(owner):
        raw = memoryview(data)
        for one, place in zip(owner.tolist(), at.tolist()):
            rest += _one_by_one(raw, place, int(ends[one]), one)
    if rest:
        found.append(tuple(np.array(column, dtype=np.int64) for column in zip(*rest)))
    if not found:
        return Fields(*[np.zeros(0, dtype=np.int64)] * 5)
    together = [np.concatenate(column) for column in zip(*found)]
    order = np.argsort(together[0], kind="stable")  # steps come in order already
    return Fields(*[column[order] for column in together])


def _counted(owner: np.ndarray, n: int, counts=None) -> np.ndarray:
    return np.bincount(owner, weights=counts, minlength=n).astype(np.int64)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = sums(sizes)
    text = pa.Array.from_buffers(
        pa.large_string(), len(sizes),
        [None, pa.py_buffer(offsets), pa.py_buffer(data[flat(starts, sizes)])])
    text.validate(full=True)
    return text


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: T.DataType
              ) -> tuple[pa.Array, np.ndarray]:
    """All values of the features at the given places, and how many each has."""
    n, wanted = len(starts), feature_kind(kind)
    lists = fields(data, starts, ends)
    parts = fields(data, lists.start, lists.end)
    require(bool((lists.number[parts.owner] == wanted).all()),
            f"a feature has values of another kind than {kind.simpleString()}")
    owner, sizes = lists.owner[parts.owner], parts.end - parts.start
    if wanted == BYTES:
        return _strings(data, parts.start, parts.end).cast(pa.string()), _counted(owner, n)
    raw = data[flat(parts.start, sizes)]
    if wanted == FLOATS:
        require(bool((sizes % 4 == 0).all()), "a list of floats is cut off")
        return pa.array(raw.view("<f4")), _counted(owner, n, sizes // 4)
    last = raw < 0x80
    behind = sums(last)
    edges = sums(sizes)
    counts = behind[edges[1:]] - behind[edges[:-1]]
    begins = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.zeros(0, np.int64)
    number = np.cumsum(last) - last  # which number a byte belongs to
    step = np.arange(len(raw)) - begins[number] if len(raw) else begins
    require(not len(raw) or bool(last[-1]) and int(step.max()) < 10, "a number in a record is cut off")
    part = (raw & 0x7F).astype(np.uint64) << (np.uint64(7) * step.astype(np.uint64))
    values = np.bitwise_or.reduceat(part, begins) if len(raw) else np.zeros(0, dtype=np.uint64)
    whole = pa.array(values.view(np.int64))
    return (whole.cast(pa.int32()) if isinstance(kind, T.IntegerType) else whole,
            _counted(owner, n, counts))


class _Entries:
    """The entries of a map in every record: whose they are, their keys and values."""

    def __init__(self, data: np.ndarray, records: Fields, number: int):
        maps = records[records.number == number]
        entries = fields(data, maps.start, maps.end)
        parts = fields(data, entries.start, entries.end)
        n = len(entries)
        self.data, self.owner = data, maps.owner[entries.owner]
        self.places = []
        for wanted in (1, 2):
            start, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            some = parts[parts.number == wanted]
            start[some.owner], end[some.owner] = some.start, some.end
            self.places.append((start, end))

    def of(self, name: str, records: int) -> np.ndarray:
        """The entry with this key in each record, -1 for none; the last one counts."""
        key, (start, end) = np.frombuffer(name.encode(), dtype=np.uint8), self.places[0]
        sized = np.flatnonzero(end - start == len(key))
        same = (self.data[start[sized][:, None] + np.arange(len(key))] == key).all(axis=1)
        out = np.full(records, -1, dtype=np.int64)
        out[self.owner[sized[same]]] = sized[same]
        return out

    def keys(self) -> pa.Array:
        return _strings(self.data, *self.places[0])


def _listed(counts: np.ndarray, values: pa.Array, missing: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(sums(counts).astype(np.int32))
    if missing is None or not missing.any():
        return pa.ListArray.from_arrays(offsets, values)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing))


def columns(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, schema: T.StructType
            ) -> list[pa.Array]:
    """The columns of the records between the positions. ``data`` has PADDING bytes behind it."""
    n, records = len(starts), fields(data, starts, ends)
    maps: dict[int, _Entries] = {}
    out = []
    for f in schema:
        levels = depth(f.dataType)
        number = 2 if levels == 2 else 1
        if number not in maps:
            maps[number] = _Entries(data, records, number)
        at = maps[number].of(f.name, n)
        found = at >= 0
        start, end = (place[at[found]] for place in maps[number].places[1])
        if levels == 2:
            inner = fields(data, start, end)
            values, counts = _features(data, inner.start, inner.end, leaf(f.dataType))
            values, counts = _listed(counts, values), _counted(inner.owner, len(start))
        else:
            values, counts = _features(data, start, end, leaf(f.dataType))
        every = np.zeros(n, dtype=np.int64)
        every[found] = counts
        if levels:
            out.append(_listed(every, values, ~found))
        else:
            first = pa.array(sums(every)[:-1], mask=every == 0)
            out.append(values.take(first))
    return out


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """(feature, kind, depth) that occur; depth 0 is one value, 1 a list, 2 a list of lists."""
    records, seen = fields(data, starts, ends), set()
    for number in (1, 2):
        entries = _Entries(data, records, number)
        names = entries.keys().dictionary_encode()
        start, end = entries.places[1]
        owner = np.arange(len(start))
        if number == 2:
            inner = fields(data, start, end)
            start, end, owner = inner.start, inner.end, inner.owner
        kinds = fields(data, start, end)
        parts = fields(data, kinds.start, kinds.end)
        # How many values: elements, packed floats, or numbers told by their last bytes.
        sizes, kind = parts.end - parts.start, kinds.number[parts.owner]
        ending = sums(data[flat(parts.start, sizes)] < 0x80)
        edges = sums(sizes)
        counts = np.where(kind == BYTES, 1, np.where(
            kind == FLOATS, sizes // 4, ending[edges[1:]] - ending[edges[:-1]]))
        many = _counted(parts.owner, len(kinds), counts) != 1
        levels = np.full(len(kinds), 2) if number == 2 else many.astype(np.int64)
        which = names.indices.to_numpy()[owner[kinds.owner]]
        for key, kind_, level in set(zip(which.tolist(), kinds.number.tolist(), levels.tolist())):
            seen.add((names.dictionary[key].as_py(), kind_, level))
    return sorted(seen)
