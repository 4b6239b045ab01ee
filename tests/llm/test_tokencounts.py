import collections

import odd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import tokencounts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
SPECIAL = "<|endoftext|>"
ODD = "a₏b"  # classed differently by different Unicode versions


def library(text):
    return len(MODEL.encode(text or "", add_special_tokens=False).ids)


def rows():
    giant = "x" * 200_000
    return [*odd.texts(), (30, f"one{SPECIAL}two {SPECIAL}"), (31, SPECIAL * 3), (32, ODD),
            (33, giant), (34, f"{giant} {giant}\n\n  {giant}"), (35, " " * 200_000 + "x"),
            (36, "it's we'll  I'M 　x​ 'S"), (37, "a\x00b \x1c\x85"),
            (38, "<|endoftext|" + SPECIAL + "|>")]


@pytest.mark.parametrize("frequent", [3, 65_536])
@pytest.mark.parametrize("cache", [1, 1000])
def test_counts_are_the_librarys(spark, frequent, cache):
    docs = odd.documents(spark, rows()).repartition(3)
    lengths = tc.frequent_lengths(docs, PATH, frequent=frequent)
    assert 0 < len(lengths) <= frequent
    got = tc.count_tokens(docs, PATH, lengths=lengths, cache=cache)
    assert set(docs.columns) <= set(got.columns)
    want = collections.Counter((i, library(t)) for i, t in rows())
    assert want == collections.Counter((r.doc_id, r.n_tokens) for r in got.collect())


def test_no_pre_token_is_shuffled(spark):
    docs = odd.documents(spark, rows())
    plan = tc.judge_lengths(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_limit_bytes_and_replaced_columns(spark):
    docs = spark.createDataFrame([(1, "é " * 3, 9), (2, None, 9)],
                                 "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tc.judge_lengths(docs, PATH, limit=5).collect()}
    assert (got[1].n_bytes, got[1].n_tokens) == (9, library("é " * 3))
    assert got[1].over_limit == (library("é " * 3) > 5)
    assert (got[2].n_bytes, got[2].n_tokens, got[2].over_limit) == (0, 0, False)
    assert tc.judge_lengths(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from(" \n\t'sSréaA1<|>")), max_size=40))
def test_any_text(text):
    counter = tc.TokenCounter(PATH, tc.LengthTable([(" a", 1), ("a", 1)]), 10)
    assert counter.count([text, text + SPECIAL + text]) == [
        library(text), library(text + SPECIAL + text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=4), unique=True, max_size=60), st.text(max_size=3))
def test_table_finds_what_it_holds(words, other):
    table = tc.LengthTable([(w, len(w) + 1) for w in words])
    assert table.find(words).tolist() == [len(w) + 1 for w in words]
    if other not in words:
        assert table.find([other]).tolist() == [0]


def test_pieces_keep_pre_tokens(monkeypatch):
    monkeypatch.setattr(tc, "_PIECE", 5)
    cut = tc.PreTokens(PATH)
    for _, text in rows():
        if text and len(text) < 50_000:
            parts = list(tc.pieces(text))
            assert "".join(parts) == text
            assert [w for p in parts for w in cut.find(p)] == cut.find(text)


def test_summaries_keep_what_is_frequent():
    seen = tc.Summary(10)
    for n in range(3000):
        seen.add(["often", f"rare{n}", f"seldom{n % 700}"])
    seen.shrink()
    assert len(seen.counts) <= 10 and "often" in seen.counts


def test_cache_is_bounded():
    cache = tc.Cache(10)
    for n in range(100):
        cache.put(str(n), n)
        assert len(cache.young) + len(cache.old) <= 10
    assert cache.get("99") == 99 and cache.get("0") is None


def test_other_vocabularies_are_refused(spark):
    docs = odd.documents(spark)
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        with pytest.raises(ValueError):
            tc.count_tokens(docs, public_tokenizers.path(name))
