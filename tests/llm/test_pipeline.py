"""The stages of the pipeline against plain versions, on small and awkward tables."""

import collections

import numpy as np
import odd
import public_tokenizers
import pytest
from test_pairs import _brute

import corpus_pipeline as cp
from millrace.llm import pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def _stage(name):
    return next(f for n, f in cp.STAGES if n.startswith(name))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_awkward_and_empty_tables(spark, name):
    docs = odd.documents(spark)
    out = _stage(name)(spark, docs, FOLDER)
    if name != cp.STAGES[-1][0]:
        assert out.columns == docs.columns and out.schema["n_chars"].dataType.typeName() == "long"
    assert out.count() > 0
    assert _stage(name)(spark, docs.limit(0), FOLDER).count() == 0


def test_language(spark, docs):
    kept = {r.doc_id for r in _stage("language")(spark, docs, FOLDER).collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet")
             .where("quality = 1").collect()}
    assert clean <= kept
    rejected = _stage("language")(spark, odd.documents(spark), FOLDER).collect()
    assert not {r.doc_id for r in rejected} & {1, 2, 3, 14, 16}


def test_lines(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    key = lambda s: s.strip(" \t\x0b\x0c\r").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = collections.Counter(k for r in rows for k in {key(x) for x in r.text.split("\n")})
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not key(x) or seen[key(x)] < 10)
            for r in rows}
    got = _stage("line")(spark, docs, FOLDER).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got) and any(seen[k] >= 10 for k in seen)


def test_one_of_similar(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    component = _brute(rows, k=5, percent=80)
    want = {i for i, (_, c) in component.items() if c == i}
    got = [r.doc_id for r in _stage("n-gram")(spark, docs, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows)


def test_mix(spark, docs):
    had = collections.Counter()
    for r in docs.select("source", "text").collect():
        had[r.source] += len(odd.words(r.text))
    total, weights = sum(had.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(had))}
    full = {}
    while True:  # fill by weight; what is above three times the source is shared again
        left = total - sum(3 * had[s] for s in full)
        open_weight = sum(w for s, w in weights.items() if s not in full)
        target = {s: 3 * had[s] if s in full else left * w / open_weight
                  for s, w in weights.items()}
        over = [s for s in target if s not in full and target[s] > 3 * had[s]]
        if not over:
            break
        full |= dict.fromkeys(over)
    got = collections.Counter()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in _stage("mixing")(spark, docs, FOLDER).collect():
        got[r.source] += len(odd.words(r.text))
        whole = odd.words(texts[r.doc_id])
        assert odd.words(r.text) == whole[:len(odd.words(r.text))]
    assert got == {s: int(t) for s, t in target.items()}


def test_pieces_stage(spark, docs):
    v = pieces.vocabulary(public_tokenizers.path(cp.VOCABULARY))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = _stage("SentencePiece")(spark, docs, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        assert bytes(r.ids) == v.encode(v.normalize(texts[r.doc_id])) and r.round_trip
        assert r.n_pieces == len(np.frombuffer(bytes(r.ids), "<u4"))


def test_run_is_all_stages(spark, docs):
    out = docs
    for _, stage in cp.STAGES:
        out = stage(spark, out, FOLDER)
        out.cache().count()
    once, again = (collections.Counter((r.doc_id, r.n_pieces, bytes(r.ids)) for r in d.collect())
                   for d in (cp.run(spark, FOLDER), out))
    spark.catalog.clearCache()
    assert once == again and len(once) > 100
