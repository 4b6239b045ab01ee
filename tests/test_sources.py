import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import readers, tfrecord, wire, writers


@pytest.fixture(scope="module")
def goods(spark):
    return spark.createDataFrame(
        [("a", "tea", 1, [1, 2]), ("b", None, 0, [3]), ("c", None, None, None), ("d", "x", 2, [])],
        "key string, goods_name string, is_prepay int, tags array<int>")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1), ("b;c", 2), (None, 3)], "s string, i int")
    writers.write_csv(df, str(tmp_path / "c"), "error", sep=";")
    back = readers.read_csv(spark, str(tmp_path / "c"), sep=";", header=False)
    assert rows(back) == [("a", 1), ("b;c", 2), (None, 3)]
    with pytest.raises(Exception):
        writers.write_csv(df, str(tmp_path / "c"), "error")
    writers.write_csv(df, str(tmp_path / "c"), "overwrite", header=True)
    assert readers.read_csv(spark, str(tmp_path / "c")).columns == ["s", "i"]


def test_text_formats_keep_microseconds(spark, tmp_path):
    df = spark.sql("select timestamp_ntz '2024-01-02 03:04:05.678912' as a, "
                   "timestamp '2024-01-02 03:04:05.678912' as b")
    writers.write_json(df, str(tmp_path / "j"), "error")
    assert rows(readers.read_json(spark, str(tmp_path / "j"), schema=df.schema)) == rows(df)
    writers.write_csv(df, str(tmp_path / "c"), "error")
    back = readers.read_csv(spark, str(tmp_path / "c"), header=False, schema=df.schema)
    assert rows(back) == rows(df)


def test_json_and_lists_of_paths(spark, goods, tmp_path):
    for name in ("x", "y"):
        writers.write_json(goods, str(tmp_path / name), "error")
    both = readers.read_json(spark, f"{tmp_path}/x, {tmp_path}/y", schema=goods.schema)
    assert both.count() == 8
    (tmp_path / "m.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.read_json(spark, str(tmp_path / "m.json"), multiline=True).count() == 2
    with pytest.raises(ValueError):
        readers.read_parquet(spark, " , ")


def test_text_needs_one_text_column(spark, goods, tmp_path):
    with pytest.raises(Exception):
        writers.write_text(goods, str(tmp_path / "t"), "error")
    writers.write_text(goods.select("key"), str(tmp_path / "t"), "error")
    assert readers.read_text(spark, str(tmp_path / "t")).columns == ["value"]


def test_orc_parquet_table(spark, goods, tmp_path):
    writers.write_orc(goods, str(tmp_path / "o"), "error")
    writers.write_parquet(goods, str(tmp_path / "p"), "error")
    assert rows(readers.read_orc(spark, str(tmp_path / "o"))) == rows(goods)
    assert rows(readers.read_parquet(spark, str(tmp_path / "p"))) == rows(goods)
    writers.write_table(goods, "goods_table", "overwrite", ["key"], str(tmp_path / "t"))
    kept = readers.read_table(spark, "goods_table", "key < 'c' and is_prepay = 1")
    assert [r["goods_name"] for r in kept.collect()] == ["tea"]
    assert "PartitionFilters: [isnotnull(key" in kept._jdf.queryExecution().toString()
    assert readers.read_sql(spark, "select count(*) as n from goods_table").first()["n"] == 4
    spark.sql("drop table goods_table")


def test_jdbc_options(spark, monkeypatch):
    """No database is started: the calls to Spark are recorded."""
    seen = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.jdbc",
                        lambda self, *a, **k: seen.append((a, k)))
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.jdbc",
                        lambda self, *a, **k: seen.append((a, k)))
    readers.read_jdbc(spark, "jdbc:x:y", "t", "user=me;password=a=b")
    readers.read_jdbc(spark, "jdbc:x:y", "t", {"user": "me"}, ("k", 0, 100, 8))
    writers.write_jdbc(spark.range(1), "jdbc:x:y", "t", mode="append")
    assert seen == [
        (("jdbc:x:y", "t"), {"properties": {"user": "me", "password": "a=b"}}),
        (("jdbc:x:y", "t"), {"properties": {"user": "me"}, "column": "k", "lowerBound": 0,
                             "upperBound": 100, "numPartitions": 8}),
        (("jdbc:x:y", "t"), {"properties": {}})]
    with pytest.raises(ValueError):
        readers.jdbc_properties("user")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "u", "t", partition=("k", 1))


def test_libsvm(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    df = readers.read_libsvm(spark, str(tmp_path / "f.txt"), num_features=4)
    assert [(r["label"], r["features"].toArray().tolist()) for r in df.collect()] == [
        (1.0, [0.5, 0.0, 2.0, 0.0]), (0.0, [0.0, 1.0, 0.0, 0.0])]
    assert readers.read_libsvm(spark, str(tmp_path / "f.txt")).first()["features"].size == 3


def test_keyed_files(spark, tmp_path):
    folder = tmp_path / "1" / "2" / "3" / "history"
    folder.mkdir(parents=True)
    (folder / "s1_g1").write_bytes(b"\x00\x01")
    (folder / "plain").write_bytes(b"z")
    got = readers.read_keyed_binary(
        spark, str(tmp_path) + "/{first}/*/*/{dt}", "([^_]+)_(.+)", ("a1", "a2"), layout="files",
        path_pattern=r"/(\d+)/(\d+)/(\d+)/[^/]+/[^/]+$", path_names=("a", "b", "c"),
        values={"first": "1", "dt": "history"})
    assert rows(got.drop("path")) == [
        ("plain", b"z", "", "", "1", "2", "3"), ("s1_g1", b"\x00\x01", "s1", "g1", "1", "2", "3")]
    with pytest.raises(ValueError):
        readers.read_keyed_binary(spark, "x", "(.)", ("a",), layout="zip")


def crc32c(data: bytes) -> int:
    """Bit by bit, masked as in the record format."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    messages = [b"123456789", b"", b"a" * 100, bytes(range(256)), b"\xff"]
    assert [int(c) for c in tfrecord.masked_crcs(messages)] == [crc32c(m) for m in messages]
    assert list(tfrecord.masked_crcs([])) == []


def _records(data: bytes, size: int = 1 << 20) -> list[bytes]:
    import pyarrow as pa
    return [bytes(block[a:b]) for block, starts, ends in
            tfrecord.blocks(pa.BufferReader(data), 0, len(data), size)
            for a, b in zip(starts, ends)]


def _framed(*bodies: bytes) -> bytes:
    """Records made one by one."""
    out = b""
    for body in bodies:
        size = struct.pack("<Q", len(body))
        out += size + struct.pack("<I", crc32c(size)) + body + struct.pack("<I", crc32c(body))
    return out


@pytest.mark.parametrize("size", [13, 20, 40, 1000])
def test_frames_are_checked(size):
    bodies = [b"one", b"", b"three", b"x" * 300]
    framed = _framed(*bodies)
    whole = wire.Bytes(np.frombuffer(b"".join(bodies), dtype=np.uint8), np.array([0, 3, 3, 8]),
                       np.array([3, 0, 5, 300]))
    assert tfrecord.frame(whole).tobytes() == framed
    assert _records(framed, size) == bodies
    with pytest.raises(ValueError, match="checksum"):
        _records(framed.replace(b"one", b"two"), size)
    with pytest.raises(ValueError, match="checksum"):
        _records(b"\x04" + framed[1:], size)
    with pytest.raises(ValueError, match="ends inside"):
        _records(framed[:-2], size)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=30), st.integers(1, 200), st.integers(90, 300))
def test_index_of_stretches(bodies, split, window):
    import pyarrow as pa
    data = _framed(*bodies)
    found = tfrecord.index_file(pa.BufferReader(data), len(data), split, window)
    assert [a for a, _, _ in found] == [0, *[b for _, b, _ in found]][:len(found)]
    assert sum(n for _, _, n in found) == len(bodies) and (not found or found[-1][1] == len(data))
    assert all(b - a >= split for a, b, _ in found[:-1])
    assert [r for a, b, _ in found for r in _records(data[a:b])] == bodies


def _bodies(piece) -> list[bytes]:
    out = np.zeros(int(piece.size.sum()), dtype=np.uint8)
    at = wire.sums(piece.size)
    piece.fill(out, at[:-1])
    return [out[a:b].tobytes() for a, b in zip(at, at[1:])]


def _columns(records: list[bytes], schema) -> list[list]:
    at = wire.sums(np.array([len(r) for r in records]))
    data = np.frombuffer(b"".join(records) + bytes(wire.PADDING), dtype=np.uint8)
    return [c.to_pylist() for c in wire.columns(data, at[:-1], at[1:], schema)]


def test_known_example_bytes():
    """An Example with {'a': [1, 300]}, encoded by the published format."""
    schema = T.StructType([T.StructField("a", T.ArrayType(T.LongType()))])
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"a": [1, 300]}])
    want = bytes.fromhex("0a0e0a0c0a01611207" + "1a050a0301ac02")
    assert _bodies(wire.messages(batch, schema, "Example")) == [want]
    # Readers also accept numbers that are not packed.
    loose = bytes.fromhex("0a0e0a0c0a01611207" + "1a05" + "0801" + "08ac02")
    for times in (1, 40):  # one by one, and in step
        assert _columns([want, loose] * times, schema) == [[[1, 300], [1, 300]] * times]
    with pytest.raises(ValueError, match="another kind"):
        _columns([want], T.StructType().add("a", T.StringType()))
    with pytest.raises(ValueError):
        _columns([want[:-1]], schema)


CELLS = {
    "i": (T.LongType(), st.integers(-2**63, 2**63 - 1)),
    "n": (T.IntegerType(), st.integers(-2**31, 2**31 - 1)),
    "f": (T.FloatType(), st.floats(width=32, allow_nan=False)),
    "s": (T.StringType(), st.text(st.characters(exclude_categories=["Cs"]), max_size=200)),
}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_columns_round_trip(data):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    schema, cells = T.StructType(), {}
    for name, (kind, values) in CELLS.items():
        for level in range(3):
            schema.add(f"{name}{level}", kind)
            cells[f"{name}{level}"] = st.none() | values
            kind, values = T.ArrayType(kind), st.lists(values, max_size=4)
    rows_ = data.draw(st.lists(st.fixed_dictionaries(cells), min_size=1, max_size=3))
    rows_ *= data.draw(st.sampled_from([1, 30]))
    batch = pa.RecordBatch.from_pylist(rows_, schema=to_arrow_schema(schema))
    records = _bodies(wire.messages(batch, schema, "SequenceExample"))
    assert _columns(records, schema) == [[r[c] for r in rows_] for c in schema.names]
    assert _columns(records, T.StructType().add("other", T.LongType())) == [[None] * len(rows_)]


def test_one_file_feeds_many_tasks(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.range(5000, numPartitions=1).withColumn("t", F.repeat(F.lit("x"), 50))
    tfrecord.write_tfrecord(df, path, "error")
    assert len([n for n in os.listdir(path) if n.endswith(".tfrecord")]) == 1
    back = tfrecord.read_tfrecord(spark, path, df.schema, split=20_000)
    read = back.withColumn("p", F.spark_partition_id())
    assert read.select("p").distinct().count() >= 8
    assert rows(back) == rows(df)
    assert dict(tfrecord.read_tfrecord(spark, path, split=20_000).dtypes) == dict(df.dtypes)


def test_small_stretches_share_tasks(spark, tmp_path):
    """The number of tasks does not grow with the number of stretches, nor their order change."""
    path = str(tmp_path / "r")
    df = spark.range(20_000, numPartitions=1).withColumn("t", F.repeat(F.lit("x"), 50))
    tfrecord.write_tfrecord(df, path, "error")
    assert tfrecord.index_records(spark, path, 2_000).count() > 500
    back = tfrecord.read_tfrecord(spark, path, df.schema, split=2_000)
    assert 8 <= back.rdd.getNumPartitions() <= 32
    assert rows(back) == rows(df)
    assert list(tfrecord._joined([("a", 0, 5), ("a", 5, 9), ("b", 9, 12), ("b", 14, 20)])) == [
        ("a", 0, 9), ("b", 9, 12), ("b", 14, 20)]


def test_a_lost_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.range(10)
    tfrecord.write_tfrecord(df, path, "error")
    before = sorted(os.listdir(path))
    with pytest.raises(Exception):
        tfrecord.write_tfrecord(df.select(F.raise_error(F.lit("lost")).cast("string").alias("id")),
                                path, "overwrite")
    assert sorted(os.listdir(path)) == before
    # A second attempt at a move or a deletion finds it done.
    tfrecord._published(path, "_gone")(before[-1])
    tfrecord._deleted(path)(f"{path}/never")
    with pytest.raises(FileNotFoundError):
        tfrecord._published(path, "_gone")("never")


def test_tfrecord_round_trip(spark, goods, tmp_path):
    path = str(tmp_path / "r")
    df = goods.withColumn("x", F.col("is_prepay").cast("float")).withColumn(
        "big", F.lit(-2**63).cast("bigint")).repartition(3)
    tfrecord.write_tfrecord(df, path, "error")
    names = os.listdir(path)
    assert names and all(n.endswith(".tfrecord") for n in names)
    assert rows(tfrecord.read_tfrecord(spark, path, df.schema)) == rows(df)
    tfrecord.write_tfrecord(df, path, "append")
    assert tfrecord.read_tfrecord(spark, path, df.schema).count() == 8
    tfrecord.write_tfrecord(df.limit(1), path, "overwrite")
    assert tfrecord.read_tfrecord(spark, path, df.schema).count() == 1
    tfrecord.write_tfrecord(df, path, "ignore")
    assert tfrecord.read_tfrecord(spark, path, "key string, unknown int").columns == [
        "key", "unknown"]
    with pytest.raises(ValueError, match="exists"):
        tfrecord.write_tfrecord(df, path, "error")


def test_tfrecord_sequences_and_types(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1, [["a", "b"], []], [[1.5]]), (2, [], None)],
                               "k bigint, w array<array<string>>, f array<array<float>>")
    with pytest.raises(ValueError, match="SequenceExample"):
        tfrecord.write_tfrecord(df, path, "error")
    tfrecord.write_tfrecord(df, path, "error", "SequenceExample")
    assert rows(tfrecord.read_tfrecord(spark, path, df.schema, "SequenceExample")) == rows(df)
    with pytest.raises(ValueError, match="cast it first"):
        tfrecord.write_tfrecord(spark.range(1).select(F.lit(1.5).alias("d")), path, "overwrite")
    with pytest.raises(ValueError, match="record type"):
        tfrecord.write_tfrecord(df, path, "overwrite", "Other")


def test_tfrecord_schema_is_found(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "x", 0.5, [1, 2], [["a"], ["b", "c"]]), (2, None, 1.5, [3], [[]])],
        "i bigint, s string, f float, v array<bigint>, w array<array<string>>").repartition(2)
    path = str(tmp_path / "q")
    tfrecord.write_tfrecord(df, path, "error", "SequenceExample")
    back = tfrecord.read_tfrecord(spark, path, record_type="SequenceExample")
    assert back.columns == ["f", "i", "s", "v", "w"]
    assert dict(back.dtypes) == dict(df.dtypes)
    assert rows(back.select(df.columns)) == rows(df)
    mixed = spark.createDataFrame([("text",)], "i string")
    tfrecord.write_tfrecord(mixed, path, "append", "SequenceExample")
    with pytest.raises(ValueError, match="several kinds"):
        tfrecord.read_tfrecord(spark, path, record_type="SequenceExample")


def test_day_segment():
    import datetime
    assert readers.day_segment("current", datetime.date(2024, 3, 1)) == "20240229"
    assert (readers.day_segment("history"), readers.day_segment("all")) == ("history", "*")
    with pytest.raises(ValueError):
        readers.day_segment("tomorrow")


def _record_folder(spark, tmp_path):
    from millrace.sources.tfrecord import read_tfrecord, write_tfrecord
    frame = spark.range(10).withColumn("t", F.lit("x"))
    root = str(tmp_path / "records")
    for part in (root, f"{root}/dt=1", f"{root}/dt=2/deep"):
        write_tfrecord(frame, part, "append")
    return root, lambda path: read_tfrecord(spark, path, "id long, t string").count()


def test_records_of_nested_folders_and_globs(spark, tmp_path):
    root, count = _record_folder(spark, tmp_path)
    assert count(root) == 30 and count(f"file://{root}") == 30
    assert count(f"{root}/dt=*") == 20 and count(f"{root}/dt=[12]") == 20
    assert count(f"{root}/dt={{1,9}}") == 10 and count(f"{root}/dt=1,{root}/dt=2") == 20
    assert count(f"{root}/*/*.tfrecord") == 10
    with pytest.raises(Exception, match="no such path"):
        count(f"{root}/dt=7*")
    with pytest.raises(Exception):
        count("nowhere://a/b")


def test_records_of_an_empty_folder(spark, tmp_path):
    _, count = _record_folder(spark, tmp_path)
    (tmp_path / "empty" / "inside").mkdir(parents=True)
    assert count(str(tmp_path / "empty")) == 0


def test_checksums_of_long_messages():
    import time

    import numpy as np

    from millrace.sources import tfrecord as tf

    def plain(message):
        table, crc = [int(x) for x in tf._crc_table()], 0xFFFFFFFF
        for byte in message:
            crc = table[(crc ^ byte) & 0xFF] ^ crc >> 8
        crc ^= 0xFFFFFFFF
        return ((crc >> 15 | crc << 17) + tf.CRC_MASK_DELTA) & 0xFFFFFFFF
    sizes = [0, 1, 12, 4095, 4096, 4097, 8192, 20_000, 50_001]
    messages = [bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)) for n in sizes]
    assert tf.masked_crcs(messages).tolist() == [plain(m) for m in messages]
    start = time.perf_counter()
    tf.masked_crcs([b"x" * (1 << 20)])
    assert time.perf_counter() - start < 2
