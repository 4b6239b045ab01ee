import itertools
import os
import random
from collections import defaultdict

import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chaining, components, ngramjoin, shingles


def _sets(rows, k):
    out = {}
    for i, text in rows:
        w = odd.words(text)
        out[i] = ({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k
                  else {tuple(w)} if w else set())
    return out


def _brute(rows, k=4, percent=85):
    sets, inverse, common = _sets(rows, k), defaultdict(list), defaultdict(int)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in sets.items():
        for g in s:
            inverse[g].append(i)
    for ids in inverse.values():
        for a, b in itertools.combinations(ids, 2):
            common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _found(df, **options):
    return {r.id: (r.n_shingles, r.component_id)
            for r in ngramjoin.jaccard_components(df, **options).collect()}


def test_components_of_the_table(spark):
    docs = spark.read.parquet(
        os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _found(docs) == _brute(rows)


@pytest.mark.parametrize("rounds,least", [(1, 3), (2, 50)])
def test_components_of_hard_groups(spark, rounds, least):
    """Variants of a text that are linked in chains, hardly linked, or just not linked."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = base[:]
        for at in r.sample(range(60), r.randint(0, 3)):
            words[at] = f"x{r.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    for i in range(60, 75):  # a chain: each differs from the next at one end only
        rows.append((i, " ".join(f"c{j}" for j in range(i, i + 40))))
    for i in range(75, 100):  # unrelated texts that share a passage
        rows.append((i, " ".join([f"u{i}-{j}" for j in range(50)] + base[:20])))
    rows += [(100 + n, t) for n, (_, t) in enumerate(odd.texts())]
    want = _brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 30
    assert _found(odd.documents(spark, rows), star_rounds=rounds, frequent_least=least) == want


_ODD_TEXTS = [None, "", " ", "a", "A b\tC", "a b c d", "\n\n", "a b c d e", "x" * 200 + " y z w",
              "x" * 199 + "v y z w", "é日 " * 80, "q" * 300_000 + " r s t u", "\ud800 a b c d", " a b c d "]


@pytest.mark.parametrize("k", [1, 4])
def test_shingles_of_many_texts_together(k):
    """As many, and the same ones in common, as sets of words in a row give."""
    def plain(text):
        words = shingles.split_words(text)
        size = min(k, len(words))
        return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()

    texts = _ODD_TEXTS + ["one two three four five six"] * 2
    found = shingles.shingle_sets(texts, k)
    wanted = [plain(t) for t in texts]
    for i, a in enumerate(found):
        assert (np.diff(a.astype(object)) > 0).all()
        assert (shingles.shingle_sets([texts[i]], k)[0] == a).all()
        for j, b in enumerate(found):
            assert len(np.intersect1d(a, b)) == len(wanted[i] & wanted[j])
    assert shingles.shingle_sets([], k) == []


def test_missing_and_repeated_ids(spark):
    docs = odd.documents(spark)
    got = ngramjoin.jaccard_components(docs)
    assert got.count() == docs.count()
    rows = {(r.id, r.n_shingles, r.component_id) for r in got.collect()}
    assert (None, 197, 6) in rows and (7, 197, 6) in rows and (None, 0, None) in rows
    assert (1, 0, 1) in rows and (2, 0, 2) in rows
    one = ngramjoin.one_of_each(docs)
    kept = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns
    assert kept.count(6) == 1 and 7 not in kept and 8 not in kept and {1, 2, 3} <= set(kept)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1),
       st.integers(0, 5))
def test_filters_never_lose_a_link(a, b, seed):
    x, y = (np.sort(ngramjoin.shingles.mix(np.array(sorted(s), dtype=np.uint64))) for s in (a, b))
    if not ngramjoin.similar(len(a & b), len(a), len(b), 85):
        return
    frequent = np.sort(ngramjoin.shingles.mix(np.arange(0, 60, 3, dtype=np.uint64)))
    least = ngramjoin.least_overlap(len(x), len(y), 85)
    orders = [[ngramjoin.rare_first(t, frequent, len(t)) for t in (x, y)],
              [ngramjoin.prefix_under(t, seed, len(t)) for t in (x, y)]]
    differ = (np.unpackbits(ngramjoin.bitmap(x).view(np.uint8))
              != np.unpackbits(ngramjoin.bitmap(y).view(np.uint8))).sum()
    assert differ <= len(a ^ b) <= len(x) + len(y) - 2 * least
    for p, q in orders:
        assert set(p[:len(x) - least + 1].tolist()) & set(q[:len(y) - least + 1].tolist())
        assert len(x) - least + 1 <= ngramjoin.prefix_size(len(x), 85)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2300)]
    edges += [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in parent}


# --- Passages ---------------------------------------------------------------

def _score(x, y, path, k, gap):
    total = k
    for a, b in zip(path, path[1:]):
        if x[b] <= x[a] or y[b] <= y[a]:
            return None
        total += k - gap * (x[b] - x[a] + y[b] - y[a] - 2)
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=9, unique=True))
def test_best_chain(matches):
    matches.sort()
    x, y = [m[0] for m in matches], [m[1] for m in matches]
    scores = [_score(x, y, p, 4, 0.3) for n in range(1, len(x) + 1)
              for p in itertools.combinations(range(len(x)), n)]
    found = chaining.chains(x, y, 4, 0.3)
    assert abs(found[0][0] - max(s for s in scores if s is not None)) < 1e-9
    assert sorted(i for _, p in found for i in p) == list(range(len(x)))
    for score, path in found:
        assert abs(_score(x, y, path, 4, 0.3) - score) < 1e-9 or path[0] != 0


def _passages(spark, rows, **options):
    return chaining.shared_passages(odd.documents(spark, rows), **options).collect()


def test_planted_passages(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [r.choice(words) for _ in range(n)]
    passage, clean = fresh(60), [(i, " ".join(fresh(150))) for i in range(10)]
    fuzzy = passage[:]
    for at in (10, 25, 40, 52):
        fuzzy[at] = "other"
    del fuzzy[30]
    rows = clean + [(20 + i, " ".join(fresh(30) + passage + fresh(i))) for i in range(8)]
    rows += [(40, " ".join(fresh(30) + fuzzy + fresh(20))), (41, " ".join(passage[:40] + fresh(90)))]
    got = {r.id: r for r in _passages(spark, rows)}
    assert set(got) == {21, 22, 23, 24, 25, 26, 27, 40}
    for i in range(21, 28):
        assert (got[i].start_word, got[i].end_word, got[i].other_id, got[i].similarity) == (30, 90, 20, 1)
    assert got[40].other_id == 20 and 0.8 <= got[40].similarity < 1 and got[40].matched_words == 55


def test_long_equal_runs_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    seen, sharing = {}, set()
    for i, text in sorted(rows):
        w = odd.words(text)
        for j in range(len(w) - 49):
            first = seen.setdefault(tuple(w[j:j + 50]), i)
            if first != i:
                sharing.add((i, first))
    got = chaining.shared_passages(docs).collect()
    assert {i for i, _ in sharing} <= {r.id for r in got}
    for r in got:
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8
    texts = {i: odd.words(t) for i, t in rows}
    for r in got:
        if r.similarity == 1:
            assert (texts[r.id][r.start_word:r.end_word]
                    == texts[r.other_id][r.other_start:r.other_end])


def test_awkward_rows(spark):
    got = chaining.shared_passages(odd.documents(spark)).collect()
    pairs = {(r.id, r.other_id, r.start_word, r.end_word) for r in got}
    assert {(7, 6, 0, 200), (8, 6, 0, 200), (None, 6, 0, 200)} <= pairs
    assert all(r.id not in (1, 2, 3, 4, 5) for r in got)


def test_frequent_passage_makes_one_row_each(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{passage} tail{i}") for i in range(300)]
    assert len(_passages(spark, rows)) == 299


def _spans(rows):
    return {(r.id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end) for r in rows}


def _different(n, name):
    return [f"{name}{i}" for i in range(n)]


def test_extension_keeps_the_core(spark):
    """Words that agree beyond a gap, after or before it, do not lose the passage itself."""
    core, line, phrase = (_different(n, c) for n, c in ((55, "p"), (15, "l"), (3, "f")))
    ends = [(core[:50] + _different(20, n) + line, line + _different(20, n) + core[:50],
             core + _different(20, n) + phrase) for n in ("a", "b")]
    for kind, (s, e) in enumerate(((0, 50), (35, 85), (0, 55))):
        got = _passages(spark, [(i, " ".join(w[kind])) for i, w in enumerate(ends)])
        assert _spans(got) == {(1, s, e, 0, s, e)}


def test_every_passage_of_a_chain(spark):
    """A gap or an insertion inside a chain does not end what is found of it."""
    first, second, third = (_different(n, c) for n, c in ((100, "p"), (100, "q"), (90, "r")))
    rows = [(1, first + _different(40, "a") + second), (2, first + _different(40, "b") + second),
            (3, third), (4, third[:45] + _different(60, "i") + third[45:]),
            (5, _different(60, "s") + _different(30, "c") + _different(55, "t")),
            (6, _different(60, "s") + _different(30, "d") + _different(55, "t"))]
    got = _passages(spark, [(i, " ".join(w)) for i, w in rows], least_words=45)
    for i, other, starts in ((2, 1, ((0, 100), (140, 240))), (4, 3, ((0, 45), (105, 150))),
                             (6, 5, ((0, 60), (90, 145)))):
        for s, e in starts:
            assert any(r.id == i and r.other_id == other and r.start_word <= s and r.end_word >= e
                       for r in got), (i, s, e)


@pytest.mark.parametrize("words", [50, 60, 100])
def test_recall_of_fuzzy_passages(spark, words):
    """Every fifth to tenth word replaced, and replaced at random: all passages are found."""
    r, rows, wanted = random.Random(words), [], set()
    for n in range(40):
        passage = _different(words, f"p{n}-")
        fuzzy = passage[:]
        for at in (range(2, words, 5 + n % 6) if n < 20 else r.sample(range(3, words - 3), words // 5)):
            fuzzy[at] = "x"
        rows += [(2 * n, _different(20, f"a{n}-") + passage + _different(20, f"b{n}-")),
                 (2 * n + 1, _different(30, f"c{n}-") + fuzzy + _different(9, f"d{n}-"))]
        wanted.add((2 * n + 1, 2 * n))
    got = _passages(spark, [(i, " ".join(w)) for i, w in rows])
    assert wanted <= {(r.id, r.other_id) for r in got if r.end_word - r.start_word >= 50}


def test_passage_of_which_smaller_documents_hold_halves(spark):
    passage, fuzzy = _different(80, "p"), _different(80, "q")
    other = fuzzy[:]
    other[20] = other[60] = "x"
    rows = [(1, passage[:40] + _different(20, "a")), (2, passage[40:] + _different(20, "b")),
            (3, _different(9, "c") + passage), (4, passage[:45] + _different(9, "d") + passage),
            (5, passage[:40]), (6, passage[40:]), (7, passage + _different(9, "e")),
            (11, fuzzy[:40] + _different(20, "f")), (12, fuzzy[40:] + _different(20, "g")),
            (13, fuzzy), (14, other)]
    got = _passages(spark, [(i, " ".join(w)) for i, w in rows])
    for i, s in ((4, 54), (7, 0), (14, 0)):
        assert any(r.id == i and r.start_word <= s and r.end_word >= s + 80 for r in got), i
    assert not {r.id for r in got} & {1, 2, 3, 5, 6, 11, 12, 13}


def test_links_go_on_over_batches(spark):
    r = random.Random(3)
    rows = sorted({(r.randint(0, 9), r.randint(0, 12), r.randint(0, 99)) for _ in range(400)})
    want = set()
    for s, group in itertools.groupby(rows, key=lambda x: x[0]):
        places = defaultdict(list)
        for _, d, p in group:
            places[d].append(p)
        docs = sorted(places)
        for before, d in zip(docs, docs[1:]):
            for o in (docs[0], before):
                want |= {(s, d, o, x, y) for x in places[d] for y in places[o]}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    try:
        got = chaining.match_seeds(spark.createDataFrame(rows, "seed long, doc long, place int"))
        got = [(r.doc, r.other, r.x, r.y) for r in got.collect()]
    finally:
        spark.conf.unset(name)
    assert len(got) == len(want) and set(got) == {w[1:] for w in want}


def test_two_later_documents_are_linked(spark):
    """Smaller documents hold all parts of what two later ones share, and so do those between."""
    passage = _different(60, "p")
    parts = [passage[:24], passage[18:42], passage[36:]]
    first, second = passage[:], passage[:]
    first[30], second[45] = "x", "y"
    rows = [(at + n, part + _different(30, f"t{at + n}-"))
            for at in (1, 11) for n, part in enumerate(parts)]
    rows += [(10, first), (20, second), (30, second)]
    got = _passages(spark, [(i, " ".join(w)) for i, w in rows])
    assert {(r.id, r.other_id, r.start_word, r.end_word, r.matched_words) for r in got} == {
        (20, 10, 0, 60, 58), (30, 20, 0, 60, 60)}


def test_a_hot_seed_is_matched_in_shares(monkeypatch):
    monkeypatch.setattr(chaining, "_ITEM", 50)
    monkeypatch.setattr(chaining, "_PART", 6)
    r = random.Random(5)
    rows = sorted({(s, r.randint(0, 40), r.randint(0, 99)) for s in (1, 2, 3, 4, 5)
                   for _ in range(1 if s == 5 else 40 * s - 35)})
    seed, doc, place = (np.array(c, np.uint64 if n == 0 else np.int64) for n, c in enumerate(zip(*rows)))
    packed = [chaining.unpack_seeds(b) for _, b in chaining.pack_seeds(seed << np.uint64(20), doc, place)]
    for had, kept in zip((seed, doc, place), map(np.concatenate, zip(*packed))):
        assert had.tolist() == kept.tolist()
    got = []
    for cut, part in chaining.items_of(seed, doc):
        x, y = chaining.places_of_item(seed[part], doc[part], cut)
        got += zip(part[x].tolist(), part[y].tolist())
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and b[1] < a[1]}
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 12), st.integers(0, 12)), min_size=1,
                max_size=12))
def test_longest_extents(steps):
    runs, i, j = [], 0, 0
    for n, skip_a, skip_b in steps:
        runs.append((i, j, n))
        i, j = i + n + skip_a, j + n + skip_b
    good = []
    for p in range(len(runs)):
        for q in range(p, len(runs)):
            long = [runs[q][s] + runs[q][2] - runs[p][s] for s in (0, 1)]
            agreed = sum(n for _, _, n in runs[p:q + 1])
            if min(long) >= 40 and agreed / max(long) >= 0.8:
                good.append(min(long))
    found = chaining.best_extents(runs, 40, 0.8)
    assert max((min(e - s, u - t) for s, e, t, u, _ in found), default=0) == max(good, default=0)
    for s, e, t, u, agreed in found:
        assert min(e - s, u - t) >= 40 and agreed >= 0.8 * max(e - s, u - t)
    assert all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(found, found[1:]))
