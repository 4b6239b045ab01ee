"""Small tables with everything that is awkward, shared by the tests of this folder."""

import random

CLASHING = ["_key", "_row", "_row_check", "_lost", "_text", "_lang", "_score", "_ids", "_place",
            "_words", "_lines", "_input", "key", "id", "size", "n_words", "kept", "ids", "node",
            "component", "label", "start", "_block", "seed"]


def texts() -> list:
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"]
    long = " ".join(r.choice(vocabulary) for _ in range(30_000))
    base = [r.choice(vocabulary) for _ in range(200)]
    near = base[:]
    near[50] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"),
        (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(near)),
        (9, long), (10, "x" * 5000), (11, "日本語のテキスト" * 300), (12, "Ünï çödé ÀÉ"),
        (13, "a a a a a a a a\na a a a\n\na a a a"), (14, "12 34 !!! ???"),
        (None, " ".join(base)), (None, None), (15, "line one\nline two\n  LINE ONE  "),
        (16, "\n\n\n"), (6, " ".join(base)), (17, "tab\tand\x0bmore\x0c\r\nends\x1c here"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, ["en", "de", None][n % 3], [None, "b", "a"][n % 3], 0 if t is None else len(t))
            for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.withColumn(name, df["n_chars"].cast("string"))
    return df


def words(text) -> list[bytes]:
    return (text or "").encode().lower().split()
