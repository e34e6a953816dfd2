"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from strikeline.llm import periodic_runs as pr
from strikeline.llm.queries import QUERIES
from tests.conftest import DATA


def brute_runs(words, least_length=6, least_exponent=4):
    """Every stretch that no neighbour extends, by period; of one stretch the smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least_length, least_exponent * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 5)):
        out += rng.choices("abcdefgh", k=rng.randint(0, 12))
        piece = rng.choices("abc", k=rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))
        size = rng.randint(1, 6 * len(piece))
        out += [piece[i % len(piece)] for i in range(size)]
    return out


def in_numbers(documents):
    names = {}
    codes = np.array([names.setdefault(w, len(names)) for d in documents for w in d], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    got = [[] for _ in documents]
    for d, *run in zip(*(x.tolist() for x in pr.runs_in(codes, offsets, 6, 4)), strict=True):
        got[d].append(tuple(run))
    return got


@pytest.mark.parametrize("seed", range(6))
def test_like_plain_search(seed):
    rng = random.Random(seed)
    documents = [random_words(rng) for _ in range(400)] + [[]] * 3
    documents += [["a"] * n for n in (1, 2, 5, 6, 7, 64, 65)]
    documents += [["a", "b"] * n for n in (3, 4, 16)] + [list("abcab" * 9 + "abc" * 20)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    documents += [list(fib[-1]), list("".join("ab" if bin(i).count("1") % 2 else "ba" for i in range(99)))]
    assert in_numbers(documents) == [brute_runs(d) for d in documents]
    assert any(in_numbers(documents))


@pytest.mark.parametrize("documents", [
    [[]], [["a"]], [["a", "b", "c"]], [["a", "b"] * 2, [], ["c"]], [["a"] * 3], [],
])
def test_documents_without_candidates(documents):
    assert in_numbers(documents) == [[] for _ in documents]


def test_every_period_at_the_least_length():
    """Runs of exactly four periods, begun at every place against the blocks."""
    documents = [
        [f"x{i}" for i in range(before)] + [f"w{i % q}" for i in range(4 * q)] + ["end"]
        for q in range(2, 40) for before in range(0, 2 * q, 3)
    ]
    for d, runs in zip(documents, in_numbers(documents), strict=True):
        assert runs == brute_runs(d) and len(runs) == 1
    short = [d[:-2] for d in documents]
    assert not any(in_numbers(short))


def test_successor_like_a_scan():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 300)
    tree = pr.WaveletTree(values.astype(np.int32), 6)
    low = rng.integers(0, 300, 500)
    high = np.minimum(300, low + rng.integers(0, 40, 500))
    x = rng.integers(0, 55, 500)
    there, found = tree.successor(low.astype(np.int32), high.astype(np.int32), x.astype(np.int32))
    want = {
        i: min(v for v in values[a:b] if v >= k)
        for i, (a, b, k) in enumerate(zip(low, high, x, strict=True)) if (values[a:b] >= k).any()
    }
    assert dict(zip(there.tolist(), found.tolist(), strict=True)) == want


def test_odd_documents(documents, odd_pairs):
    pairs = [*odd_pairs, (20, "a " * 50 + "b c \x1c"), (20, "A a " * 9), (21, "\v\f x y\tx\ny x y x y x\r")]
    found = pr.find_runs(documents(pairs)).collect()
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found)
    want = []
    for i, t in pairs:
        runs = [] if len(words_of(t)) > 50_000 else brute_runs(words_of(t))
        want.append((str(i), runs, collapsed(words_of(t), runs)))
    assert got == sorted(want)
    assert pr.find_runs(documents([])).count() == 0
    with pytest.raises(ValueError):
        pr.find_runs(documents([]), least_exponent=3)


def expected(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    )


def test_query_equals_plain_search(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    rows = [r for r in rows if len(words_of(r[1])) < 3000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    want = [expected(*r) for r in rows]
    assert sum(w[1] for w in want) > 5
    for w in want:
        assert got[w[0]] == w


def test_planted_documents(documents, odd_pairs):
    pairs = [*odd_pairs, *((i, f"w{i} x y z " * (i % 9)) for i in range(100, 180))]
    pairs = [p for p in pairs if p[1] is None or len(p[1]) < 5000]
    got = pr.digests(pr.find_runs(pr.with_planted_runs(documents(pairs)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted([expected(*p) for p in pairs], key=str)
