"""TFRecord files: reading, writing, and finding their schema.

A record is framed as length, checksum, bytes, checksum. The bytes are an ``Example`` (a map of
features) or a ``SequenceExample`` (a map of features and a map of feature lists). A feature is a list
of bytes, floats or whole numbers. Blocks of records are coded as columns (``sources.wire``).

Files cannot be split where one likes, so large ones are indexed first: a task walks from one length to
the next and notes where stretches of whole records begin. The index is a table; a task reads one of its
stretches, or several small ones that follow each other. Files are written below a temporary name, listed in a manifest by the
tasks that succeeded, and given their names by a second job.
"""

from __future__ import annotations

import functools
import posixpath
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import wire
from millrace.util import require, written

RECORD_TYPES = ("Example", "SequenceExample")

# The reversed CRC-32C polynomial and the mask of the record format.
CRC32C_POLYNOMIAL = 0x82F63B78
CRC_MASK_DELTA = 0xA282EAD8

_BLOCK_BYTES = 8 << 20  # about what a task reads at a time
_SPLIT_BYTES = 64 << 20  # the size of a stretch of a large file
_TASKS = 32  # so many tasks are worth starting for small stretches, whatever the session plans
_BLOCK = 4096  # bytes of a message that one step of the checksum passes over
_HEAD, _TAIL = 12, 4  # length and checksum before a message, checksum behind it


def _crc_table():
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


def _registers(data, starts, sizes, first: int):
    """The CRC register after each stretch of ``data``, one byte position at a time for all.

    Stretches are visited longest first, so that position i touches exactly those that have an
    i-th byte.
    """
    table = _crc_table()
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    crc = np.full(len(starts), first, dtype=np.uint32)
    alive = len(starts)
    for position in range(int(sizes[0]) if alive else 0):
        while sizes[alive - 1] <= position:
            alive -= 1
        byte = data[starts[:alive] + position]
        crc[:alive] = table[(crc[:alive] ^ byte) & 0xFF] ^ (crc[:alive] >> 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


@functools.cache
def _shift_tables():
    """What a whole block of zeros makes of a register, for each value of each of its four bytes."""
    images = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    table = _crc_table()
    for _ in range(_BLOCK):
        images = table[images & 0xFF] ^ (images >> 8)
    values = np.arange(256, dtype=np.uint32)
    tables = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte] ^= np.where(values >> bit & 1, images[8 * byte + bit], 0).astype(np.uint32)
    return tables


def masked_crcs_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The masked CRC-32C of every stretch of the data.

    Long messages are cut into blocks of equal length that are processed side by side. The register
    is linear, so a block's own register, begun at zero, is added to what the block's length makes
    of the register before it.
    """
    heads, blocks = lengths % _BLOCK, lengths // _BLOCK
    crc = _registers(data, starts, heads, 0xFFFFFFFF)
    if blocks.any():
        before = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        number = np.arange(int(blocks.sum())) - np.repeat(before, blocks)
        block_starts = np.repeat(starts + heads, blocks) + number * _BLOCK
        own = _registers(data, block_starts, np.full(len(number), _BLOCK), 0)
        shift = _shift_tables()
        for i in range(int(blocks.max())):
            at = np.flatnonzero(blocks > i)
            old = crc[at]
            crc[at] = (shift[0][old & 0xFF] ^ shift[1][old >> 8 & 0xFF] ^ shift[2][old >> 16 & 0xFF]
                       ^ shift[3][old >> 24] ^ own[before[at] + i])
    crc = ~crc
    return ((crc >> 15) | (crc << 17)) + np.uint32(CRC_MASK_DELTA)


def masked_crcs(messages: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of every message."""
    lengths = np.array([len(m) for m in messages], dtype=np.int64)
    starts = (np.cumsum(lengths) - lengths).astype(np.int64)
    return masked_crcs_at(np.frombuffer(b"".join(messages), dtype=np.uint8), starts, lengths)


def frame(bodies: wire.Piece) -> np.ndarray:
    """Records ready to be written, in one buffer."""
    n, size = len(bodies.size), bodies.size
    at = wire.sums(size + _HEAD + _TAIL)
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    starts = at[:-1]

    def put(places, values: np.ndarray) -> None:
        width = values.dtype.itemsize
        out[places[:, None] + np.arange(width)] = values.view(np.uint8).reshape(n, width)
    if n:
        put(starts, size.astype("<u8"))
        bodies.fill(out, starts + _HEAD)
        put(starts + 8, masked_crcs_at(out, starts, np.full(n, 8)).astype("<u4"))
        put(starts + _HEAD + size, masked_crcs_at(out, starts + _HEAD, size).astype("<u4"))
    return out


def walk(data) -> list[int]:
    """Where the records begin whose lengths the data holds, and where the last of them ends, which
    may be behind the data."""
    places, at, end = [0], 0, len(data)
    while end - at >= _HEAD:
        at += struct.unpack_from("<Q", data, at)[0] + _HEAD + _TAIL
        places.append(at)
    return places


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return data[at[:, None] + np.arange(width)].reshape(-1).view(kind)


def _check_crcs(data: np.ndarray, starts, lengths, stored) -> None:
    if (masked_crcs_at(data, starts, lengths) != _numbers(data, stored, "<u4")).any():
        raise ValueError("a record does not match its checksum")


def _heads(at: np.ndarray) -> tuple:
    """The lengths that begin at these places, and their checksums."""
    return at, np.full(len(at), 8), at + 8


def blocks(stream, start: int, end: int, size: int = _BLOCK_BYTES
           ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The records of a stretch of a file: blocks of data, and where each message begins and ends.

    ``stream`` can be read at any place. Checksums are compared.
    """
    while start < end:
        raw = stream.read_at(min(size, end - start), start)
        places = walk(raw)
        if len(places) == 2 and places[1] > len(raw):  # longer than a block
            _check_crcs(np.frombuffer(raw, dtype=np.uint8), *_heads(np.zeros(1, np.int64)))
            raw = stream.read_at(min(places[1], end - start), start)
        while places[-1] > len(raw):
            places.pop()
        if len(places) < 2:
            raise ValueError("the file ends inside a record")
        data = np.frombuffer(raw[:places[-1]] + bytes(wire.PADDING), dtype=np.uint8)
        at = np.array(places, dtype=np.int64)
        heads, starts, ends = at[:-1], at[:-1] + _HEAD, at[1:] - _TAIL
        _check_crcs(data, *_heads(heads))
        _check_crcs(data, starts, ends - starts, ends)
        yield data, starts, ends
        start += places[-1]


def index_file(stream, size: int, split: int, window: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(start, end, records) of stretches of at least ``split`` bytes, from the lengths alone.

    Records that are longer than a window are stepped over without being read.
    """
    out, first, records, at = [], 0, 0, 0
    while at < size:
        raw = stream.read_at(min(window, size - at), at)
        places = np.array(walk(raw), dtype=np.int64)
        if len(places) < 2 or at + places[-1] > size:
            raise ValueError("the file ends inside a record")
        _check_crcs(np.frombuffer(raw, dtype=np.uint8), *_heads(places[:-1]))
        ends, done = at + places[1:], 0
        at = int(ends[-1])
        while True:
            cut = int(np.searchsorted(ends, first + split))
            if cut == len(ends):
                break
            out.append((first, int(ends[cut]), records + cut + 1 - done))
            first, records, done = int(ends[cut]), 0, cut + 1
        records += len(ends) - done
    if first < size:
        out.append((first, size, records))
    return out


def _filesystem(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        try:
            return fs.FileSystem.from_uri(path)
        except pa.ArrowInvalid as unknown:
            raise ValueError(f"TFRecord files cannot be reached at {path}: {unknown}") from None
    return fs.LocalFileSystem(), path


_COMMA = re.compile(r",(?![^{]*\})")  # not inside braces


def _qualified(spark: SparkSession, path: str) -> str:
    """The paths of a comma list with their file systems, as the session resolves them."""
    out = []
    for one in (p.strip() for p in _COMMA.split(path) if p.strip()):
        place = spark._jvm.org.apache.hadoop.fs.Path(one)
        full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
        out.append("file://" + full[len("file:"):] if re.match("file:/[^/]", full) else full)
    require(bool(out), "no path is given")
    return ",".join(out)


_GLOB = re.compile(r"[*?\[{]")


def _pattern(path: str) -> re.Pattern:
    """A glob with * ? [a-b] [^a] and {a,b} as a pattern of whole paths; none but / is special."""
    out = ""
    for part in re.findall(r"\*|\?|\[\^?[^\]]*\]|\{[^}]*\}|[^*?\[{]+|.", path):
        if part == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif part[0] == "[" and part[-1] == "]":
            out += part
        elif part[0] == "{" and part[-1] == "}":
            out += "(?:" + "|".join(map(re.escape, part[1:-1].split(","))) + ")"
        else:
            out += re.escape(part)
    return re.compile(out)


def _shown(path: str, root: str) -> bool:
    """Whether no part of the path below ``root`` is hidden."""
    below = posixpath.relpath(path, root) if path != root else ""
    return not any(p.startswith(("_", ".")) and p not in ("", ".") for p in below.split("/"))


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of all files of the paths of a comma list: folders with the folders below them, and globs."""
    from pyarrow import fs
    found = []
    for one in _COMMA.split(path):
        if _GLOB.search(one):
            # An address with a glob is no address: only its beginning is looked up.
            fixed = one[:_GLOB.search(one).start()].rpartition("/")[0] + "/"
            system, root = _filesystem(fixed)
            root = root.rstrip("/") or "/"
            wanted = _pattern(root.rstrip("/") + "/" + one[len(fixed):].strip("/"))
            listed = [f for f in system.get_file_info(
                fs.FileSelector(root, allow_not_found=True, recursive=True))
                if _shown(f.path, root)]
            roots = [f for f in listed if wanted.fullmatch(f.path)]
        else:
            system, root = _filesystem(one)
            roots = [system.get_file_info(root)]
        if not roots or roots[0].type == fs.FileType.NotFound:
            raise ValueError(f"no such path: {one}")
        for info in roots:
            if info.type == fs.FileType.File:
                found.append(info)
            else:
                found += [f for f in system.get_file_info(fs.FileSelector(info.path, recursive=True))
                          if f.type == fs.FileType.File and _shown(f.path, info.path)]
    return sorted({(f.path, f.size) for f in found if f.size})


def _system(path: str):
    return _filesystem(_GLOB.split(_COMMA.split(path)[0])[0])[0]


_STRETCHES = "path string, start long, end long"


def index_records(spark: SparkSession, path: str, split: int = _SPLIT_BYTES) -> DataFrame:
    """The stretches of all files: ``path``, ``start``, ``end``.

    A file that is no larger than ``split`` is one stretch. Larger ones are walked through, each by
    one task that reads lengths only, and the result is kept as a table.
    """
    require(split > 0, "stretches need a size")
    files = _files(_qualified(spark, path))
    small = spark.createDataFrame([(f, 0, size) for f, size in files if size <= split], _STRETCHES)
    large = [(f, size) for f, size in files if size > split]
    if not large:
        return small
    base = _qualified(spark, path)

    def walked(batches):
        system = _system(base)
        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(file) as stream:
                    found = index_file(stream, size, split)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found)), *[pa.array(c, pa.int64())
                                                      for c in list(zip(*found))[:2]]],
                    names=["path", "start", "end"])
    listed = spark.createDataFrame(large, "path string, size long").repartition(len(large))
    return small.unionByName(written(listed.mapInArrow(walked, _STRETCHES), "record-index"))


def _joined(stretches) -> Iterator[tuple[str, int, int]]:
    """Stretches that follow each other in one file as one."""
    held = None
    for file, start, end in stretches:
        if held is not None and held[0] == file and held[2] == start:
            held = (file, held[1], end)
        else:
            if held is not None:
                yield held
            held = (file, start, end)
    if held is not None:
        yield held


def _read(spark: SparkSession, path: str, split: int, schema: T.StructType, coded: Callable
          ) -> DataFrame:
    """One task for each stretch, or for neighbours where there are more of them than tasks that the
    session plans for and than tasks of ``_SPLIT_BYTES``; ``coded`` turns a block of records into
    columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    base, arrow = _qualified(spark, path), to_arrow_schema(schema)
    stretches = index_records(spark, path, split)
    n, size = stretches.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")),
                                                          F.lit(0))).first()
    planned = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS, -(-size // _SPLIT_BYTES))
    tasks = max(1, min(n, planned))
    numbered = stretches.coalesce(1).withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.repartitionById(tasks, F.floor(F.col("_row") * tasks / max(1, n)).cast("int")
                                      ).sortWithinPartitions("_row").drop("_row")

    def run(batches):
        system = _system(base)
        for batch in batches:
            for file, start, end in _joined(zip(*(c.to_pylist() for c in batch.columns))):
                with system.open_input_file(file) as stream:
                    for block in blocks(stream, start, end):
                        yield pa.RecordBatch.from_arrays(coded(*block), schema=arrow)
    return placed.mapInArrow(run, schema)


def infer_schema(spark: SparkSession, path: str, record_type: str = "Example",
                 split: int = _SPLIT_BYTES) -> T.StructType:
    """The schema of the records, in the order of the feature names, from one pass over all.

    A feature with one value in every record is a plain column, else a list.
    """
    _check_type(record_type)

    def described(data, starts, ends):
        found = list(zip(*wire.shapes(data, starts, ends))) or [[], [], []]
        return [pa.array(c, k) for c, k in zip(found, (pa.string(), pa.int32(), pa.int32()))]
    found = (_read(spark, path, split, SHAPES, described)
             .groupBy("feature").agg(F.max("depth").alias("depth"),
                                     F.collect_set("kind").alias("kinds")))
    schema = T.StructType()
    for row in sorted(found.collect()):  # one row per feature
        require(len(row["kinds"]) == 1, f"feature {row['feature']} has values of several kinds")
        kind = KINDS[row["kinds"][0]]
        for _ in range(row["depth"]):
            kind = T.ArrayType(kind)
        schema.add(row["feature"], kind)
    return schema


def read_tfrecord(spark: SparkSession, path: str, schema=None, record_type: str = "Example",
                  split: int = _SPLIT_BYTES) -> DataFrame:
    """Records of text, float, int and long values and lists.

    ``path`` is a file, a folder (with all folders below), a glob, or several of these with commas
    between; without a scheme it is on the session's file system. Without a schema an extra pass
    over the records finds it. Files of more than ``split`` bytes are read by several tasks.
    """
    _check_type(record_type)
    if schema is None:
        schema = infer_schema(spark, path, record_type, split)
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    for field in schema:
        _check(field.dataType, 2)
    return _read(spark, path, split, schema,
                 lambda data, starts, ends: wire.columns(data, starts, ends, schema))


def _check_type(record_type: str) -> None:
    require(record_type in RECORD_TYPES, f"unknown record type: {record_type}")


def _check(kind: T.DataType, depth_left: int) -> None:
    if isinstance(kind, T.ArrayType):
        require(depth_left > 0, "lists of lists need the record type SequenceExample")
        _check(kind.elementType, depth_left - 1)
    else:
        require(isinstance(kind, (T.StringType, T.FloatType, T.IntegerType, T.LongType)),
                f"{kind.simpleString()} is not supported in TFRecord; cast it first")


# What inference asks of the reader: one row per feature and shape that occurs.
SHAPES = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("kind", T.IntegerType()),
    T.StructField("depth", T.IntegerType())])

# The kinds of feature in the record format.
KINDS = {wire.BYTES: T.StringType(), wire.FLOATS: T.FloatType(), wire.INTS: T.LongType()}


def write_tfrecord(df: DataFrame, path: str, mode: str, record_type: str = "Example") -> None:
    """Write one file per task; ``mode`` is append, overwrite, ignore or error.

    Tasks write below a temporary folder and report their files. The report of the attempts that
    succeeded is the manifest; a second job gives its files their names, and only then do
    overwritten files go. A job that fails leaves nothing.
    """
    _check_type(record_type)
    for field in df.schema:
        _check(field.dataType, 2 if record_type == "SequenceExample" else 1)
    require(mode in ("append", "overwrite", "ignore", "error", "errorifexists"),
            f"unknown mode: {mode}")
    spark = df.sparkSession
    path = _qualified(spark, path)
    require("," not in path and not _GLOB.search(path), "write to one path")
    if mode in ("ignore", "error", "errorifexists") and _exists(path):
        require(mode == "ignore", f"path exists already: {path}")
        return
    system, root = _filesystem(path)
    old = _files(path) if mode == "overwrite" and _exists(path) else []
    pending = f"_pending-{uuid.uuid4().hex}"
    system.create_dir(posixpath.join(root, pending), recursive=True)
    schema = df.schema
    try:
        df.mapInArrow(_writer(path, pending, schema, record_type), "name string").write.parquet(
            f"{path}/{pending}/_manifest")
        listed = spark.read.schema("name string").parquet(f"{path}/{pending}/_manifest")
        _each(listed, _published(path, pending))
        if old:
            _each(spark.createDataFrame([(f,) for f, _ in old], "name string"), _deleted(path))
    finally:
        system.delete_dir(posixpath.join(root, pending))


def _writer(path: str, pending: str, schema: T.StructType, record_type: str) -> Callable:
    def run(batches):
        from pyspark import TaskContext
        system, root = _filesystem(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tfrecord"
        out = None
        for batch in batches:
            for part in _parts(batch):
                if out is None:
                    out = system.open_output_stream(posixpath.join(root, pending, name))
                out.write(memoryview(frame(wire.messages(part, schema, record_type))))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})
    return run


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about the size of a block."""
    rows = max(1, batch.num_rows * _BLOCK_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _each(names: DataFrame, action: Callable) -> None:
    """Run ``action`` for every name, in parallel; it may be run again for the same name."""
    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                action(name)
            yield batch
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names.repartition(tasks).mapInArrow(run, "name string").write.format("noop").mode(
        "overwrite").save()


def _published(path: str, pending: str) -> Callable:
    def move(name: str) -> None:
        from pyarrow import fs
        system, root = _filesystem(path)
        old, new = posixpath.join(root, pending, name), posixpath.join(root, name)
        if system.get_file_info(old).type != fs.FileType.NotFound:
            system.move(old, new)
        elif system.get_file_info(new).type == fs.FileType.NotFound:  # else an earlier attempt did it
            raise FileNotFoundError(new)
    return move


def _deleted(path: str) -> Callable:
    def delete(name: str) -> None:
        from pyarrow import fs
        system, _ = _filesystem(path)
        if system.get_file_info(name).type != fs.FileType.NotFound:
            system.delete_file(name)
    return delete


def _exists(path: str) -> bool:
    from pyarrow import fs
    system, root = _filesystem(path)
    return system.get_file_info(root).type != fs.FileType.NotFound
