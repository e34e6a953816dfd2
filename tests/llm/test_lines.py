"""Line deduplication against plain loops, SQL and planted cases."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from strikeline.llm import line_dedup
from strikeline.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA


def brute(pairs, at_least, least_chars=1, keep_first=False):
    blank = " \t\n\v\f\r"

    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))
        return k if k and len(k) >= least_chars else None

    rows = [(i, t or "") for i, t in pairs]
    found = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        order = (i is not None, i if i is not None else 0, hashlib.sha256(t.encode()).digest())
        for k in {key(x) for x in t.split("\n")} - {None}:
            found[k].append(order)
    out = []
    for i, t in rows:
        order = (i is not None, i if i is not None else 0, hashlib.sha256(t.encode()).digest())
        kept, given = [], set()
        for line in t.split("\n"):
            k = key(line)
            if k is None or len(found[k]) < at_least:
                kept.append(line)
            elif keep_first and k not in given and min(found[k]) == order:
                kept.append(line)
            given.add(k)
        n = len(t.split("\n"))
        out.append((i, "\n".join(kept), n, n - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pairs(odd_pairs):
    rng = random.Random(13)
    shared = [f"Shared line {i} É" for i in range(30)]
    made = [
        (100 + i, "\n".join(rng.choice([
            rng.choice(shared), f"own {rng.random()}", "", "  " + rng.choice(shared).upper() + "\t\r",
            " kept ", "x",
        ]) for _ in range(rng.randint(0, 25))))
        for i in range(60)
    ]
    return odd_pairs + made + made[:5] + [(None, "Shared line 1 É\nShared line 1 É")]


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize(("at_least", "least_chars", "keep_first"), [
    (10, 1, False), (2, 1, True), (3, 4, True), (1000, 1, False),
])
def test_lines_like_brute_force(documents, pairs, at_least, least_chars, keep_first, few):
    found = line_dedup.without_repeated_lines(
        documents(pairs), at_least, least_chars, keep_first, few=few
    )
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(
        pairs, at_least, least_chars, keep_first
    )


def test_a_full_filter_gives_the_same(documents, pairs, monkeypatch):
    """With far too few bits everything is suspected and counted."""
    monkeypatch.setattr(line_dedup, "BITS_PER_LINE", 0)
    monkeypatch.setattr(line_dedup, "_HELD", 100)
    found = line_dedup.without_repeated_lines(documents(pairs), 10)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(pairs, 10)


def test_no_documents_and_one_document_keys(documents):
    assert line_dedup.without_repeated_lines(documents([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.without_repeated_lines(documents([(1, "a")]), at_least=1)


def test_only_suspects_are_counted(documents):
    """Lines of one document each have, but for a few, a bit that was seen once."""
    rows = [(i, "\n".join(f"{i} {j} alone" for j in range(50)) + "\nall have this") for i in range(80)]
    docs = documents(rows).select("doc_id", "text")
    from pyspark.sql import functions as F

    slim = docs.withColumn("text", F.col("text").cast("binary"))
    bits = line_dedup.seen_twice(slim, line_dedup.blocks_for(80 * 51), 1).collect()
    share = sum(bin(int.from_bytes(r.bits, "big")).count("1") for r in bits) / (2 * 80 * 51)
    assert share < 0.15


def test_places_packed_either_way():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 100, 4095, 4096, 60_000):
        places = np.sort(rng.choice(line_dedup.BLOCK_BITS, n, replace=False))
        bits = line_dedup._bits(line_dedup._packed(places))
        assert np.array_equal(np.flatnonzero(bits), places)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = QUERIES["op13_line_dedup"](spark, DATA).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = con.execute(ORACLES["op13_line_dedup"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
