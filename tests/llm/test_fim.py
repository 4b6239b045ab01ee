import collections
import re

import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, rate=50, spm=80):
    """Slices and joins, as the definition reads."""
    t = text or ""
    tokens = TOKEN.findall(t)
    h = fim.draws(42, doc_id)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, t
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    return [*odd.texts(), (40, "a <P> b"), (41, "a <S>"), (42, "<M>"), (43, "< P> <P"), (44, "<"),
            (45, "<P <S <M> ".replace("<M>", "<M")), (46, " lead"), (47, "trail "), (-1, "minus one"),
            (48, ">" * 9), (49, "   wide\x1fspaces \x85"), (10**18, "large id here"),
            *[(n, f"doc {n} has a few words\n and lines ") for n in range(100, 200)]]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_rows_by_plain_version(spark, rate, spm):
    docs = odd.documents(spark, rows()).repartition(3)
    got = fim.restore(fim.transform(docs, rate=rate, spm_share=spm))
    assert set(docs.columns) <= set(got.columns)
    want = collections.Counter((i, *plain_version(i, t, rate, spm), t or "") for i, t in rows())
    assert want == collections.Counter(
        (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)
        for r in got.collect())


def test_results_replace_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")],
                                 "doc_id long, text string, output string, restored string")
    got = fim.restore(fim.transform(docs))
    assert sorted(got.columns) == sorted({*docs.columns, "n", "form", "prefix_chars", "middle_chars"})
    assert got.first().restored == "a b"
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from("<>PSM \n\x0b\x1c")), max_size=60),
       st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_round_trip(text, drawn):
    made = fim.transform_text(text.encode(), drawn, 100, 50)
    assert bytes(fim.restore_text(bytes(made["output"]), made["form"])).decode() == text
    assert made["n"] == len(TOKEN.findall(text))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.data())
def test_rotation(data, draw):
    a, b, c = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    buffer = np.frombuffer(bytearray(data), dtype=np.uint8)
    fim.rotate(buffer, a, b, c)
    assert buffer.tobytes() == data[:a] + data[b:c] + data[a:b] + data[c:]


def test_long_segments_are_rotated_in_blocks():
    data = np.random.default_rng(1).integers(0, 256, 500_001, dtype=np.uint8)
    buffer = data.copy()
    fim.rotate(buffer, 3, 200_000, 499_000)
    assert (buffer == np.concatenate(
        [data[:3], data[200_000:499_000], data[3:200_000], data[499_000:]])).all()


def test_damaged_outputs_are_refused():
    for output, form in ((b"text", "psm"), (b"<S>a<M>b", "spm"), (b"<P>a<M>b", "psm"),
                         (b"<P>a", "odd")):
        with pytest.raises(ValueError):
            fim.restore_text(output, form)
