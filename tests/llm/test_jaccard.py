import random
import re
import string

import pytest

from strikeline.llm import jaccard_join
from strikeline.llm.components import components
from strikeline.llm.queries import op6_heavy_light_jaccard
from strikeline.llm.shingles import shingle_sets
from tests.conftest import DATA

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _slow(pairs):
    """doc_id -> (number of shingles, smallest linked id), comparing all with all."""
    sets = {i: _set(t) for i, t in pairs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _got(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.report(docs).collect()}


def test_shingles():
    texts = ["", " \n", "a", "A b", "a b c d", "a b c d e", "x  y\tz é w q w q w q w q w q", "É b c d e f"]
    got = shingle_sets(texts)
    assert [len(s) for s in got] == [len(_set(t)) for t in texts]
    assert shingle_sets(["A B C D E f"])[0].tolist() == shingle_sets(["a b  c\nd E F "])[0].tolist()
    assert shingle_sets(["É b c d e"])[0].tolist() != shingle_sets(["é b c d e"])[0].tolist()


def test_long_texts_are_cut_between_words(monkeypatch):
    from strikeline.llm import shingles

    text = " ".join(str(i * i) for i in range(3000)) + " " + "w" * 9000 + " end of it all"
    want = shingle_sets([text, "other words are here now"])
    monkeypatch.setattr(shingles, "_BLOCK", 512)
    for a, b in zip(want, shingle_sets([text, "other words are here now"]), strict=True):
        assert a.tolist() == b.tolist()


def test_of_the_test_table(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in op6_heavy_light_jaccard(spark, DATA).collect()}
    assert got == _slow(pairs)


def _edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def near_pairs():
    """Groups of near copies around the threshold, short texts, and a passage in many."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    pairs, doc_id = [], 0
    for size, copies, most in ((60, 60, 3), (200, 40, 9), (9, 30, 1), (14, 30, 1), (6, 20, 1)):
        for _ in range(2):
            words = rng.choices(vocabulary, k=size)
            for _ in range(copies):
                pairs.append((doc_id, " ".join(_edited(words, rng, rng.randint(0, most)))))
                doc_id += 1
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 40))
        pairs.append((doc_id, " ".join([*own, *passage])))
        doc_id += 1
    for _ in range(40):
        pairs.append((doc_id, " ".join(rng.choices(vocabulary[:6], k=rng.randint(0, 6)))))
        doc_id += 1
    return pairs


def test_around_the_threshold(documents, near_pairs):
    assert _got(documents(near_pairs)) == _slow(near_pairs)


@pytest.mark.parametrize("light", [1, 12, 10_000])
def test_any_boundary_gives_the_same(monkeypatch, documents, near_pairs, light):
    """All sets heavy, some, and (but for long ones) all light; lists cut into many parts."""
    pairs = [p for p in near_pairs if light < 100 or len(p[1].split()) < 70]
    make = jaccard_join.Order
    monkeypatch.setattr(jaccard_join, "_boundary", lambda *_: light)
    monkeypatch.setattr(jaccard_join, "Order", lambda h, c, b, p: make(h, c, b, 4))
    monkeypatch.setattr(jaccard_join, "_STAR_ROUNDS", 3)
    monkeypatch.setattr(jaccard_join, "_PAIRS_PER_ENTRY", 1)
    assert _got(documents(pairs)) == _slow(pairs)


def test_boundary_follows_cost():
    few = jaccard_join._boundary({4: 1000, 100: 1000}, 0.0)
    many = jaccard_join._boundary({4: 1000, 40: 1000, 100: 1000}, 0.9)
    assert few < 100 and many >= few


def test_odd_rows(documents, odd_pairs):
    docs = documents(odd_pairs)
    rows = jaccard_join.report(docs).collect()
    assert len(rows) == len(odd_pairs)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert got[4, 1] == got[3, 1] == 3 and got[6, got and max(n for i, n in got if i == 6)] == 5
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[None, 0] is None
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        [None, None, 1, 2, 3, 3, 5, 7, 8, 9, 10, -4], key=str
    )
    assert jaccard_join.report(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    label = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame([tuple(sorted(p)) for p in links], "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    assert got == {x: y for x, y in label.items() if x in got}
    assert all(label[x] == x for x in label.keys() - got.keys())


def test_components_of_long_chains(spark):
    rising = [(i, i + 1) for i in range(1, 1000)]
    # low ids at both ends, the highest in the middle
    order = [*range(2000, 2400, 2), *range(2399, 2000, -2)]
    links = [*rising, *[tuple(sorted(p)) for p in zip(order, order[1:], strict=False)]]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    assert got == {i: 1 if i <= 1000 else 2000 for i in [*range(1, 1001), *order]}


def test_one_of_each_judges_rows_not_ids(documents):
    words = [f"word{i}" for i in range(60)]
    near = [" ".join([*words, f"end{k}"]) for k in range(3)]
    other = [" ".join(f"{x}{i}" for i in range(40)) for x in ("p", "q")]
    pairs = [(1, near[0]), (2, near[1]), (2, other[0]), (3, other[1]), (3, near[2])]
    kept = jaccard_join.one_of_each(documents(pairs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, near[0]), (2, other[0]), (3, other[1])]
    nulls = [*[(None, t) for t in (*near, near[0], *other)], (7, other[0])]
    kept = jaccard_join.one_of_each(documents(nulls)).collect()
    assert len(kept) == 3 and {r.text for r in kept} - {*near} == {*other}
    assert {r.doc_id for r in kept if r.text == other[0]} == {7}
