import numpy as np
import odd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _ids(data) -> list[int]:
    return np.frombuffer(bytes(data), "<u4").tolist()


def _brute(v: pieces.Vocabulary, text: str) -> int:
    """The best sum of scores, over all segmentations."""
    best = {0: 0}
    for end in range(1, len(text) + 1):
        found = [best[a] + v.scores[text[a:end]] for a in range(max(0, end - v.longest), end)
                 if text[a:end] in v.scores]
        if text[end - 1] not in v.scores:
            found.append(best[end - 1] + v.unknown_score)
        best[end] = max(found)
    return best[len(text)]


def _score(v: pieces.Vocabulary, text: str, places: list[int]) -> int:
    return sum(v.scores.get(text[a:b], v.unknown_score) for a, b in zip(places, places[1:]))


_TEXT = st.text(alphabet="theandofix ▁\n.,é日😀", max_size=40)


@settings(max_examples=150, deadline=None)
@given(_TEXT)
def test_best_score_and_words(text):
    v = pieces.vocabulary(PATH)
    normal = v.normalize(text)
    _, back = v.forward(normal, {0: 0}, len(normal))
    assert _score(v, normal, v.trace(back, len(normal))) == _brute(v, normal)
    assert v.encode(normal) == v._segment(normal)
    assert v.decode(v.encode(normal)) == text.replace("▁", " ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="theandofix▁.,é日😀\U0010ffff", min_size=1, max_size=70), min_size=1, max_size=30))
def test_words_segmented_together(words):
    v = pieces.vocabulary(PATH)
    assert v.segment_all(words) == [v._segment(w) for w in words]
    v.words, v.older = {}, {}
    assert v.encode_all(words) == [v._segment(w) for w in words]


def test_ids_of_the_library(tmp_path):
    """The library's lattice over the same pieces gives the same ids."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor
    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    library = SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    v = pieces.vocabulary(PATH)
    for text in ["the cat and the dog", "of the hand", "is and retitioning ouen the of", "Enlaux de"]:
        mine = _ids(v.encode(v.normalize(text)))
        theirs = library.nbest_encode(text, nbest_size=2)[0]
        score = lambda ids: sum(v.model.get_score(i) for i in ids)
        assert score(mine) == score(theirs) and (mine == theirs or len(mine) == len(theirs))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="theandx ▁\n日", min_size=20, max_size=90), st.integers(3, 20))
def test_matrices_combine_to_the_whole(text, chunk):
    v = pieces.vocabulary(PATH)
    normal = v.normalize(text)
    total, n = None, len(normal)
    for at in range(0, n, chunk):
        m = v.matrix(normal[at:at + chunk + v.longest - 1], min(chunk, n - at), at == 0,
                     at + chunk >= n)
        total = m if total is None else pieces.combine(total, m)
    assert total[0, 0] == _brute(v, normal)


def test_giants_equal_whole_texts(spark):
    docs = odd.documents(spark)
    found = pieces.encode(docs, PATH, decoded="plain", giant=300, chunk=97, block=3)
    rows = found.collect()
    assert len(rows) == docs.count() and {"_place", "_ids", "id"} <= set(found.columns)
    v = pieces.vocabulary(PATH)
    for r in rows:
        assert bytes(r.ids) == v.encode(v.normalize(r.text or ""))
        assert r.plain == (r.text or "")
    again = pieces.decode(found, PATH, into="plain").select("text", "plain").collect()
    assert all(r.plain == (r.text or "") for r in again)


def test_a_long_text_without_blanks(spark):
    text = "abcdefghij" * 300
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pieces.encode(df, PATH, giant=1000, chunk=211, block=4).first()
    v = pieces.vocabulary(PATH)
    assert bytes(row.ids) == v._segment(v.normalize(text))


def test_empty(spark):
    assert pieces.encode(odd.documents(spark).limit(0), PATH).count() == 0
