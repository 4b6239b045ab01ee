"""Feature hashing of integer keys with a small integer prefix.

The hash is the published MurmurHash3 x64 128-bit function (its low word) over
the little-endian bytes of prefix:int32 and value:int64, repeated for a second
pair. Spark has no wrapping 64-bit multiplication outside its own hashes, so the
arithmetic runs on whole Arrow batches of unsigned numpy words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.util import check_columns, col, pairs, require

# The seed and the modulus of the encoder.
SEED = 0x3C074A61
MODULUS = 1 << 60

# The published constants of MurmurHash3 x64-128.
C1 = 0x87C37B91114253D5
C2 = 0x4CF5AD432745937F
BLOCK_ADD_1 = 0x52DCE729
BLOCK_ADD_2 = 0x38495AB5
FINAL_1 = 0xFF51AFD7ED558CCD
FINAL_2 = 0xC4CEB9FE1A85EC53


def _rotate(x, bits):
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _avalanche(x):
    for factor in (FINAL_1, FINAL_2):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def murmur3_low_word(words, n_bytes: int, seed: int = SEED):
    """Low word of MurmurHash3 x64-128, for a batch of equally long messages.

    ``words`` are the messages' little-endian 64-bit words, padded with zeros;
    a zero half-block leaves the state as it is, so a tail needs no special care.
    """
    h1 = np.full(len(words[0]), seed, dtype=np.uint64)
    h2 = h1.copy()
    padded = [*words, np.zeros_like(h1)] if len(words) % 2 else words
    for start in range(0, len(padded), 2):
        full_block = 8 * (start + 2) <= n_bytes
        h1 = h1 ^ (_rotate(padded[start] * np.uint64(C1), 31) * np.uint64(C2))
        if full_block:
            h1 = (_rotate(h1, 27) + h2) * np.uint64(5) + np.uint64(BLOCK_ADD_1)
        h2 = h2 ^ (_rotate(padded[start + 1] * np.uint64(C2), 33) * np.uint64(C1))
        if full_block:
            h2 = (_rotate(h2, 31) + h1) * np.uint64(5) + np.uint64(BLOCK_ADD_2)
    h1, h2 = h1 ^ np.uint64(n_bytes), h2 ^ np.uint64(n_bytes)
    h1 = h1 + h2
    h2 = h2 + h1
    return _avalanche(h1) + _avalanche(h2)


def _words(prefix_values):
    """The 64-bit words of one or two (prefix, value) pairs of 12 bytes each."""
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    prefixes = [np.uint64(p & 0xFFFFFFFF) for p, _ in prefix_values]
    values = [v for _, v in prefix_values]
    first = prefixes[0] | ((values[0] & low) << high)
    if len(values) == 1:
        return [first, values[0] >> high]
    return [first, (values[0] >> high) | (prefixes[1] << high), values[1]]


def _hash_batch(prefixes, columns):
    missing = np.zeros(len(columns[0]), dtype=bool)
    values = []
    for column in columns:
        missing |= column.is_null().to_numpy(zero_copy_only=False)
        filled = column.fill_null(0).to_numpy(zero_copy_only=False)
        values.append(filled.astype(np.int64).view(np.uint64))
    words = _words(list(zip(prefixes, values)))
    hashed = murmur3_low_word(words, 12 * len(values)) & np.uint64(MODULUS - 1)
    return pa.array(hashed.astype(np.int64), type=pa.int64(), mask=missing)


def _one_pair(prefix: int):
    @F.arrow_udf("bigint")
    def encoded(value: pa.Array) -> pa.Array:
        return _hash_batch([prefix], [value])
    return encoded


def _two_pairs(prefix1: int, prefix2: int):
    @F.arrow_udf("bigint")
    def encoded(value1: pa.Array, value2: pa.Array) -> pa.Array:
        return _hash_batch([prefix1, prefix2], [value1, value2])
    return encoded


def encode(*prefix_columns) -> Column:
    """Hash one or two (prefix, column) pairs to a number in [0, 2^60).

    A NULL value gives NULL.
    """
    require(len(prefix_columns) in (1, 2), "one or two (prefix, column) pairs are needed")
    prefixes = [int(p) for p, _ in prefix_columns]
    require(all(-2**31 <= p < 2**31 for p in prefixes), "a prefix is a 32-bit integer")
    values = [(c if isinstance(c, Column) else col(c)).cast("bigint") for _, c in prefix_columns]
    udf = _one_pair(*prefixes) if len(values) == 1 else _two_pairs(*prefixes)
    return udf(*values)


def concat_key(first, second) -> Column:
    """The number whose digits are those of the first number, then the second.

    NULL where an input is NULL or the digits are no 64-bit number.
    """
    digits = [(c if isinstance(c, Column) else col(c)).cast("bigint").cast("string")
              for c in (first, second)]
    return F.concat(*digits).try_cast("bigint")


def encode_concat(prefix: int, first, second, *more) -> Column:
    """Hash a concatenated key, alone or with one further (prefix, column) pair."""
    return encode((prefix, concat_key(first, second)), *more)


def hash_encode(df: DataFrame, columns, out: str) -> DataFrame:
    """Add the hash of one or two (column, prefix) pairs."""
    listed = pairs(columns)
    require(len(listed) in (1, 2), "one or two (column, prefix) pairs are needed")
    check_columns(df, [c for c, _ in listed])
    return df.withColumn(out, encode(*[(prefix, c) for c, prefix in listed]))
