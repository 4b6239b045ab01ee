"""Hash encoding, checked against the hash written out in SQL on 128-bit numbers."""

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.functions.sqlfunctions import register_sql_functions
from millrace.plans.registry import query, table

TWO64 = "18446744073709551616::uhugeint"


def _unsigned(value: str) -> str:
    return f"(({value})::hugeint + 18446744073709551616::hugeint)::uhugeint % {TWO64}"


def _times(x: str, factor: int) -> str:
    return f"(({x}) * {factor}::uhugeint) % {TWO64}"


def _rotated(x: str, bits: int) -> str:
    return f"((({x}) * {2**bits}::uhugeint) % {TWO64} + ({x}) // {2**(64 - bits)}::uhugeint)"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"


class _Steps:
    """Named intermediate results, one nested select each."""

    def __init__(self, source: str):
        self.sql, self.count = source, 0

    def add(self, expression: str) -> str:
        self.count += 1
        self.sql = f"select *, {expression} as s{self.count} from ({self.sql})"
        return f"s{self.count}"

    def add_wrapped(self, expression: str) -> str:
        return self.add(f"({expression}) % {TWO64}")


def murmur_sql(source: str, keep: str, prefix_values, out: str) -> str:
    """SQL for the encoder over the rows of ``source``."""
    steps = _Steps(source)
    size = 12 * len(prefix_values)
    half = f"{2**32}::uhugeint"
    v1 = steps.add(_unsigned(prefix_values[0][1]))
    p1 = prefix_values[0][0]
    words = [steps.add(f"{p1}::uhugeint + ({v1} % {half}) * {half}")]
    if len(prefix_values) == 1:
        words.append(steps.add(f"{v1} // {half}"))
    else:
        p2, v2 = prefix_values[1]
        words.append(steps.add(f"{v1} // {half} + {p2}::uhugeint * {half}"))
        words.append(steps.add(_unsigned(v2)))
        words.append(steps.add("0::uhugeint"))
    h1 = h2 = f"{hashing.SEED}::uhugeint"

    def mixed(word, first, bits, second):
        a = steps.add(_times(word, first))
        b = steps.add(_rotated(a, bits))
        return steps.add(_times(b, second))

    for i in range(0, len(words), 2):
        full = 8 * (i + 2) <= size
        h1 = steps.add(_xor(h1, mixed(words[i], hashing.C1, 31, hashing.C2)))
        if full:
            r = steps.add(_rotated(h1, 27))
            h1 = steps.add_wrapped(f"({r} + {h2}) * 5 + {hashing.BLOCK_ADD_1}::uhugeint")
        h2 = steps.add(_xor(h2, mixed(words[i + 1], hashing.C2, 33, hashing.C1)))
        if full:
            r = steps.add(_rotated(h2, 31))
            h2 = steps.add_wrapped(f"({r} + {h1}) * 5 + {hashing.BLOCK_ADD_2}::uhugeint")
    h1 = steps.add(_xor(h1, f"{size}::uhugeint"))
    h2 = steps.add(_xor(h2, f"{size}::uhugeint"))
    h1 = steps.add_wrapped(f"{h1} + {h2}")
    h2 = steps.add_wrapped(f"{h2} + {h1}")

    def avalanche(x):
        for factor in (hashing.FINAL_1, hashing.FINAL_2):
            x = steps.add(_xor(x, f"{x} // {2**33}::uhugeint"))
            x = steps.add(_times(x, factor))
        return steps.add(_xor(x, f"{x} // {2**33}::uhugeint"))

    h1, h2 = avalanche(h1), avalanche(h2)
    total = steps.add_wrapped(f"{h1} + {h2}")
    return f"select {keep}, ({total} % {hashing.MODULUS}::uhugeint)::bigint as {out} from ({steps.sql})"


EVENTS = """select event_id, nullif(user_id, 1) as user_id, nullif(user_id, 1) - 100 as shifted,
  event_id * 1000003 as big from events"""


def _events(spark, folder):
    user = F.nullif("user_id", F.lit(1).cast("bigint"))
    return table(spark, folder, "events").select(
        "event_id", user.alias("user_id"), (user - 100).alias("shifted"),
        (F.col("event_id") * 1000003).alias("big"))


@query("hash_encode", murmur_sql(EVENTS, "event_id, user_id", [(1, "user_id")], "code"))
def hash_encode(spark, folder):
    return hashing.hash_encode(_events(spark, folder), [("user_id", 1)], "code").select(
        "event_id", "user_id", "code")


@query("hash_encode_pair", murmur_sql(EVENTS, "event_id", [(1, "shifted"), (2, "big")], "code"))
def hash_encode_pair(spark, folder):
    return hashing.hash_encode(_events(spark, folder), [("shifted", 1), ("big", 2)],
                               "code").select("event_id", "code")


@query("hash_encode2", murmur_sql(EVENTS, "event_id", [(77, "big")], "code"))
def hash_encode2(spark, folder):
    register_sql_functions(spark)
    return _events(spark, folder).select("event_id", F.expr("encode2(77, big)").alias("code"))


@query("hash_encode4", murmur_sql(EVENTS, "event_id", [(3, "big"), (4, "shifted")], "code"))
def hash_encode4(spark, folder):
    register_sql_functions(spark)
    return _events(spark, folder).select("event_id",
                                         F.expr("encode4(3, big, 4, shifted)").alias("code"))


JOINED = "try_cast(user_id::varchar || big::varchar as bigint)"


@query("concat_key", f"select event_id, {JOINED} as k from ({EVENTS})")
def concat_key(spark, folder):
    return _events(spark, folder).select("event_id",
                                         hashing.concat_key("user_id", "big").alias("k"))


@query("hash_encode3", murmur_sql(EVENTS, "event_id", [(5, JOINED)], "code"))
def hash_encode3(spark, folder):
    return _events(spark, folder).select(
        "event_id", hashing.encode_concat(5, "user_id", "big").alias("code"))


@query("hash_encode5", murmur_sql(EVENTS, "event_id", [(5, JOINED), (6, "shifted")], "code"))
def hash_encode5(spark, folder):
    register_sql_functions(spark)
    return _events(spark, folder).select(
        "event_id", F.expr("encode5(5, user_id, big, 6, shifted)").alias("code"))
