import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import hashing, sqlfunctions, vectors

MASK = (1 << 64) - 1

# Golden values of the encoder; see FIXTURES.md.
GOLDEN = [
    ([(1, 42)], 342142326097974755),
    ([(1, 0)], 819878117867967294),
    ([(2, -1)], 960115730019127705),
    ([(1, 42), (2, 7)], 124137117970821276),
]


def brute_force(pairs):
    """The encoder, byte by byte on Python integers."""
    data = b"".join(struct.pack("<iq", p, v) for p, v in pairs)

    def rotate(x, n):
        return (x << n | x >> (64 - n)) & MASK

    def scramble(k, a, bits, b):
        return rotate(k * a & MASK, bits) * b & MASK

    h1 = h2 = hashing.SEED
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        k1, k2 = struct.unpack("<QQ", data[at:at + 16])
        h1 ^= scramble(k1, hashing.C1, 31, hashing.C2)
        h1 = ((rotate(h1, 27) + h2) * 5 + hashing.BLOCK_ADD_1) & MASK
        h2 ^= scramble(k2, hashing.C2, 33, hashing.C1)
        h2 = ((rotate(h2, 31) + h1) * 5 + hashing.BLOCK_ADD_2) & MASK
    rest = data[whole:]
    h2 ^= scramble(int.from_bytes(rest[8:], "little"), hashing.C2, 33, hashing.C1)
    h1 ^= scramble(int.from_bytes(rest[:8], "little"), hashing.C1, 31, hashing.C2)
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & MASK
    h2 = (h2 + h1) & MASK
    for factor in (hashing.FINAL_1, hashing.FINAL_2):
        h1, h2 = ((h ^ h >> 33) * factor & MASK for h in (h1, h2))
    h1, h2 = h1 ^ h1 >> 33, h2 ^ h2 >> 33
    return (h1 + h2 & MASK) % hashing.MODULUS


def test_published_vector():
    """'hello' with seed 0 has the low word 0xcbd8a7b341bd9b02."""
    word = np.array([int.from_bytes(b"hello", "little")], dtype=np.uint64)
    assert int(hashing.murmur3_low_word([word], 5, seed=0)[0]) == 0xCBD8A7B341BD9B02


@pytest.mark.parametrize("pairs,code", GOLDEN)
def test_golden(spark, pairs, code):
    assert brute_force(pairs) == code
    df = spark.createDataFrame([tuple(v for _, v in pairs)],
                               ", ".join(f"c{i} bigint" for i in range(len(pairs))))
    got = hashing.hash_encode(df, [(f"c{i}", p) for i, (p, _) in enumerate(pairs)], "code")
    assert got.first()["code"] == code


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-2**31, 2**31 - 1), st.integers(-2**63, 2**63 - 1)),
                min_size=1, max_size=2))
def test_words_against_bytes(pairs):
    import pyarrow as pa
    got = hashing._hash_batch([p for p, _ in pairs], [pa.array([v], pa.int64()) for _, v in pairs])
    assert got.to_pylist() == [brute_force(pairs)]


def test_sql_functions_and_null(spark):
    sqlfunctions.register_sql_functions(spark)
    spark.createDataFrame([(1, 42, 7), (2, -1, 3), (1, None, 7)],
                          "p int, a bigint, b bigint").createOrReplaceTempView("hash_input")
    got = spark.sql("""select encode2(p, a) as e2, encode3(p, 4, 2) as e3,
        encode4(p, a, 2, b) as e4, encode5(p, 4, 2, 2, b) as e5 from hash_input""").collect()
    assert [r["e2"] for r in got] == [342142326097974755, 960115730019127705, None]
    assert got[0]["e3"] == 342142326097974755 and got[0]["e4"] == 124137117970821276
    assert got[0]["e5"] == 124137117970821276 and got[2]["e4"] is None
    spark.catalog.dropTempView("hash_input")


def test_concat_key(spark):
    df = spark.createDataFrame([(12, 34), (0, 5), (1, -2), (10**15, 10**15), (None, 1)],
                               "a bigint, b bigint")
    assert [r[0] for r in df.select(hashing.concat_key("a", "b")).collect()] == [
        1234, 5, None, None, None]


def test_arguments(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        hashing.hash_encode(df, [], "x")
    with pytest.raises(ValueError):
        hashing.encode((1, "id"), (2, "id"), (3, "id"))
    with pytest.raises(ValueError):
        hashing.encode((2**31, "id"))


@pytest.fixture(scope="module")
def csv_vec(spark):
    return spark.createDataFrame([("1,2", "3, 4"), ("1,2", "1"), (None, "1"), ("-2", "1"),
                                  ("0.00051", "1"), ("9", "9")], "u string, v string")


def test_csv_vectors(csv_vec):
    got = csv_vec.select(vectors.csv_dot("u", "v").alias("d"),
                         vectors.similarity_bucket("u", "v").alias("b")).collect()
    assert [r["d"] for r in got] == [11.0, -1.0, None, -2.0, 0.00051, 81.0]
    assert [r["b"] for r in got] == [45, 2, None, 1, 18, 45]


def test_buckets_by_brute_force(spark):
    cuts = vectors.SIMILARITY_CUTS
    assert len(cuts) == 44 and cuts == sorted(cuts)
    probes = sorted({c + d for c in cuts for d in (-1e-9, 0.0, 1e-9)})
    df = spark.createDataFrame([(repr(x), "1", 1 + sum(c <= x for c in cuts)) for x in probes],
                               "u string, v string, want int")
    assert df.where(vectors.similarity_bucket("u", "v") != F.col("want")).count() == 0


def test_csv_vector_that_is_no_number(spark):
    bad = spark.createDataFrame([("1,x", "1,2")], "u string, v string")
    with pytest.raises(Exception):
        bad.select(vectors.csv_dot("u", "v")).collect()


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0]), ([], [])],
                               "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.dot("a", "b", -1.0)).collect()] == [11.0, -1.0, 0.0]
    assert [r[0] for r in df.select(vectors.dot("a", "b")).collect()] == [11.0, None, 0.0]
    uneven = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="length"):
        uneven.select(vectors.dot("a", "b")).collect()


def test_sum_normalize(spark):
    df = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("b", [0.0, 0.0])],
                               "k string, v array<double>")
    sums = {r["k"]: r["n"] for r in vectors.normalized_sums(df, "k", "v", "n").collect()}
    assert sums["a"] == pytest.approx([0.6, 0.8]) and sums["b"] == [0.0, 0.0]
    row = spark.createDataFrame([([[1.0, 1.0], [2.0, 3.0]],), ([[0.0]],)],
                                "v array<array<double>>")
    got = [r[0] for r in row.select(vectors.sum_normalize("v")).collect()]
    assert got[0] == pytest.approx([3 / 5, 4 / 5]) and got[1] == [0.0]
    assert math.isclose(sum(x * x for x in got[0]), 1.0)


def test_dot_in_sql(spark):
    from pyspark.ml.linalg import Vectors
    sqlfunctions.register_sql_functions(spark)
    sparse, dense = Vectors.sparse(4, [1, 3], [2.0, 5.0]), Vectors.dense(1, 2, 3, 4)
    df = spark.createDataFrame(
        [(0, dense, dense), (1, sparse, dense), (2, dense, sparse), (3, sparse, sparse),
         (4, None, dense), (5, dense, None), (6, Vectors.sparse(4, [], []), dense)],
        ["i", "a", "b"]).coalesce(1)
    df.createOrReplaceTempView("dot_input")
    got = [r[0] for r in spark.sql("select dot(a, b) from dot_input order by i").collect()]
    assert got == [30.0, 24.0, 24.0, 29.0, None, None, 0.0]
    assert spark.sql("select dot(array(1D, 2D), array(3D, 4D))").first()[0] == 11.0
    spark.createDataFrame([(dense, Vectors.dense(1, 2))], ["a", "b"]).createOrReplaceTempView(
        "dot_input")
    with pytest.raises(Exception, match="length"):
        spark.sql("select dot(a, b) from dot_input").collect()
    spark.catalog.dropTempView("dot_input")
