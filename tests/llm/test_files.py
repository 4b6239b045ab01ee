import zlib

import numpy as np
import odd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import files, grammar, warc
from millrace.util import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_warc_round_trip(spark, tmp_path):
    pages = odd.documents(spark).select(F.col("doc_id").alias("page_id"), F.lit("http://a/\n").alias("url"),
                                        F.col("text").alias("html"), "id", "key")
    roots = [scratch(spark, "warc") for _ in range(2)]
    listed = [warc.write_warc(p, root, shards=3, file_bytes=2000)
              for p, root in zip((pages, pages.repartition(5)), roots)]
    names = [sorted((r.name, r.records, r.bytes) for r in m.collect()) for m in listed]
    assert names[0] == names[1] and len(names[0]) > 3
    bodies = []
    for root in roots:
        system, base = files.file_system(files.qualified(spark, root))
        bodies.append([system.open_input_stream(f"{base}/{n}").read() for n, _, _ in names[0]])
    assert bodies[0] == bodies[1]
    got = warc.read_warc(spark, roots[0]).collect()
    assert len(got) == pages.count()
    assert all(r.payload_matches for r in got if r.record_type == "response")
    assert sum(r.record_type == "response" for r in got) == len({t or "" for _, t in odd.texts()})
    repeated = [r for r in got if r.page_id == 6]
    assert sorted(r.record_type for r in repeated) == ["response", "revisit"]
    assert {r.refers_to for r in got if r.page_id == 7} == {6}


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"),
                                   (4, "u", "long enough")], "page_id long, url string, html string")
    root = scratch(spark, "warc")
    warc.write_warc(pages, root, least_bytes=5)
    assert {r.page_id: r.refers_to for r in warc.read_warc(spark, root).collect()} == {
        1: None, 2: None, 3: None, 4: 3}


def test_unpublished_files_are_not_read(spark):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    root = scratch(spark, "warc")
    warc.write_warc(pages, root)
    system, base = files.file_system(files.qualified(spark, root))
    with system.open_output_stream(f"{base}/shard-000099-00000.warc.gz") as out:
        out.write(b"left by a lost task")
    assert warc.read_warc(spark, root).count() == 1


def test_broken_record_is_noticed():
    import io
    data = warc.record(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    assert [h["warc-type"] for h, _ in warc.records(io.BytesIO(data))] == ["response"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-6])))


def test_tokens_by_the_library(spark):
    rows = [(n, t) for n, (_, t) in enumerate(odd.texts())]
    root = scratch(spark, "tokens")
    grammar.write_tokens(odd.documents(spark, rows).repartition(4), root, PATH, shards=3,
                         file_tokens=5000, least=4)
    got = {r.doc_id: r for r in grammar.read_tokens(spark, root).collect()}
    library, start = Tokenizer.from_file(PATH), 0
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(got[i])[:4] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len({(r.shard, r.part) for r in got.values()}) > 3


def test_tokens_of_repeated_and_missing_ids(spark):
    root = scratch(spark, "tokens")
    docs = odd.documents(spark)
    grammar.write_tokens(docs, root, PATH)
    got = grammar.read_tokens(spark, root).orderBy("start").collect()
    assert len(got) == docs.count()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))


_WORDS = st.text(alphabet="abÀéİßΣς,.'’1<|>endoftextstar \n\t　́日", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(_WORDS, max_size=5))
def test_words_are_encoded_as_the_library_does(texts):
    library = Tokenizer.from_file(PATH)
    found = grammar.tokenizer(PATH).encode(texts, 2)
    for text, ids in zip(texts, found):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8), st.integers(2, 4))
def test_grammar_restores_every_range(documents, least):
    ids = [np.array(d, dtype=np.uint32) for d in documents]
    names = [None if i % 3 == 2 else -i for i in range(len(ids))]
    file = grammar.GrammarFile(grammar.pack(names, ids, 4, least=least, pairs_per_round=2))
    assert file.doc_ids == names
    assert [x.tolist() for _, x in file.documents(7)] == documents
    for i, d in enumerate(documents):
        assert file.document(i).tolist() == d
        for a in range(0, len(d), 7):
            for b in range(a + 1, len(d) + 1, 5):
                assert file.ids(i, a, b).tolist() == d[a:b]


def test_grammar_makes_repetition_small():
    ids = [np.tile(np.arange(50, dtype=np.uint32), 200)]
    symbols, _, left, _ = grammar.build_grammar(ids[0], np.array([0, 10_000]), 50)
    assert len(symbols) < 500 and len(left) > 10


def test_grammar_goes_on_until_pairs_are_rare():
    text = np.random.default_rng(1).integers(0, 5000, 3000).astype(np.uint32)
    ids, starts = np.tile(text, 64), np.arange(0, 64 * 3000 + 1, 3000)
    symbols, at, left, right = grammar.build_grammar(ids, starts, 5000)
    assert len(symbols) == 64 and at.tolist() == list(range(65))
    lengths = grammar.expansion_lengths(left, right, 5000)
    flat, begin = grammar.expansions(left, right, lengths, 5000)
    rule = int(symbols[0]) - 5000
    assert (flat[begin[rule]:begin[rule + 1]] == text).all()


def test_shards_do_not_depend_on_the_layout(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 900)
    limits = [files.range_shards(d, "x", 7)[1] for d in (df, df.repartition(11))]
    assert limits[0] == limits[1] and len(limits[0]) == 6


def test_capitals_take_the_ids_of_small_letters():
    coder = grammar.Tokenizer(PATH)
    small, = coder.encode(["housework"], 2)
    coder.library = None  # nothing is tokenized again
    large, = coder.encode(["Housework HOUSEWORK"], 2)
    assert large.tolist() == [*small[:-1], *small[:-1], 2]


def test_words_of_many_texts_are_asked_for_once():
    coder, asked = grammar.Tokenizer(PATH), []

    class Counted(type(coder.words)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    coder.words = Counted(coder, {})
    texts = [None, "", "House house\nHOUSE, house. house!! été été, 12. 12."] * 50
    ids = coder.encode(texts, 2)
    library = Tokenizer.from_file(PATH)
    wanted = library.encode(texts[2], add_special_tokens=False).ids + [2]
    assert [x.tolist() for x in ids] == [[2], [2], wanted] * 50
    assert len(asked) < 20


def test_pairs_that_are_rare_are_not_counted_again(monkeypatch):
    rng, counted, bins = np.random.default_rng(1), [], grammar._bins
    repeated = rng.integers(0, 1000, 2000).astype(np.uint32)
    documents = [np.concatenate([repeated, rng.integers(0, 1 << 20, 2000).astype(np.uint32)]) for _ in range(32)]

    def seen(left, *more):
        counted.append(len(left))
        return bins(left, *more)
    monkeypatch.setattr(grammar, "_bins", seen)
    file = grammar.GrammarFile(grammar.pack(list(range(32)), documents, 1 << 20))
    assert all((x == documents[i]).all() for i, x in file.documents())
    # The words of one document only, half of all, are counted in the first round at most.
    rounds = counted[2:]
    assert len(rounds) > 8 and max(rounds) < 32 * 2000 + 2000
