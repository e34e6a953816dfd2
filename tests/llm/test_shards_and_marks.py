import hashlib
import zlib
from collections import defaultdict

import numpy as np

from strikeline.llm import sharding, syncmers
from strikeline.llm.queries import op1_vector_shards, op5_closed_syncmers
from tests.conftest import DATA


def _checked(rows, shards, docs):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    want = sorted((i if i is not None else -99, len((t or "").encode()) + 1,
                   zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.size, r.text_crc32)
                  for r in rows) == want


def _sums(rows, value):
    out = defaultdict(int)
    for r in rows:
        out[r.shard] += value(r)
    return sorted(out.values())


def test_shards_of_the_test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = op1_vector_shards(spark, DATA).collect()
    _checked(rows, 8, docs)
    sizes = _sums(rows, lambda r: r.size)
    assert len(sizes) == 8 and sizes[-1] <= 1.08 * sum(sizes) / 8


def test_groups_stay_together_and_hot_ones_are_cut(documents):
    pairs = [(i, "the same text" if i % 3 == 0 else f"text {i // 4} " + "w " * (i % 50))
             for i in range(3000)]
    rows = sharding.shard(documents(pairs), shards=4).collect()
    _checked(rows, 4, pairs)
    for value in (lambda r: r.size, lambda r: 1, lambda r: r.tokens):
        sums = _sums(rows, value)
        assert sums[-1] <= 1.03 * sum(sums) / 4
    where = defaultdict(set)
    for r in rows:
        if r.part is None:
            where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert {r.text_crc32 for r in rows if r.part is not None} <= {zlib.crc32(b"the same text")}


def test_only_what_exceeds_a_shard_is_cut(documents):
    """A group of a tenth of all rows stays whole in eight shards; one of three tenths is cut."""
    pairs = [(i, {0: "a tenth", 1: "three tenths", 2: "three tenths", 3: "three tenths"}.get(
        i % 10, f"own text {i}")) for i in range(4000)]
    rows = sharding.shard(documents(pairs), shards=8).collect()
    _checked(rows, 8, pairs)
    where, parts = defaultdict(set), defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
        parts[r.text_crc32].add(r.part)
    cut = zlib.crc32(b"three tenths")
    assert len(where[zlib.crc32(b"a tenth")]) == 1 and len(parts[cut]) == 8
    assert all(len(s) == 1 for k, s in where.items() if k != cut)
    sums = _sums(rows, lambda r: r.size)
    assert sums[-1] <= 1.05 * sum(sums) / 8


def test_rows_equal_in_id_and_text_are_cut_too(documents):
    rows = sharding.shard(documents([(7, "all the same")] * 400), shards=4).collect()
    assert all(s <= 120 for s in _sums(rows, lambda r: 1))


def test_odd_rows_are_sharded(documents, odd_pairs):
    _checked(sharding.shard(documents(odd_pairs)).collect(), 8, odd_pairs)
    assert sharding.shard(documents([])).count() == 0


def _slow_anchors(text):
    """Closed syncmers by their definition, with the module's hash of a run of characters."""
    def hashed(run):
        h = 0
        for c in run:
            h = (h * int(syncmers._FACTOR) + ord(c) + 1) % 2**64
        return int(syncmers._mixed(np.array([h], np.uint64))[0])

    out = []
    for i in range(len(text) - syncmers.K + 1):
        run = text[i : i + syncmers.K]
        inner = [hashed(run[j : j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, hashed(run) >> (64 - syncmers._BITS)))
    return out


def test_anchors_by_definition(monkeypatch):
    text = "The quick brown fox jumps over the lazy dog; then it döes so again. " * 4
    at, h = syncmers._anchors(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    assert list(zip(at.tolist(), h.tolist(), strict=True)) == _slow_anchors(text)
    whole = syncmers.sketches([text, "", "short", text])
    monkeypatch.setattr(syncmers, "_BLOCK", 40)  # by blocks, and each text alone
    for a, b in zip(whole, syncmers.sketches([text, "", "short", text]), strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_likeness():
    a, b, c, none = syncmers.sketches(["alpha beta gamma delta epsilon " * 3, "alpha beta gamma",
                                       "something else altogether here", ""])
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(none, none) == 1
    assert syncmers.likeness(a, none) == 0 and syncmers.likeness(a, c) == 0
    assert 0 < syncmers.likeness(a, b) < 1


def _edit_rows(pairs):
    order = sorted(pairs, key=lambda p: (-(p[0] if p[0] is not None else -(2**63)), p[1] or ""))
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        yield i, len(t), hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()


def test_edit_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = op5_closed_syncmers(spark, DATA).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(_edit_rows(docs))
    text = dict(docs)
    mark = {}
    for r in rows:
        assert mark.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_odd_rows_are_marked(documents, odd_pairs):
    rows = syncmers.edit_test(documents(odd_pairs)).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str)
    assert got == sorted(_edit_rows(odd_pairs), key=str)
    assert syncmers.edit_test(documents([])).count() == 0
    one = syncmers.edit_test(documents([(1, "abc")])).collect()
    assert one[0].near_next == 1.0
    assert syncmers.fingerprints(documents(odd_pairs)).count() == len(odd_pairs)


def _slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_common_anchors_by_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for most, width in ((64, 1 << 14), (0, 1 << 14), (0, 7)):  # by equal pairs, bits, blocks of bits
        monkeypatch.setattr(syncmers, "_MATCHES", most)
        monkeypatch.setattr(syncmers, "_BITS_AT_ONCE", width)
        for _ in range(150):
            a, b = (rng.integers(0, rng.integers(2, 40), rng.integers(0, 60)).astype(np.uint64)
                    for _ in range(2))
            assert syncmers._common(a, b) == _slow_common(a.tolist(), b.tolist())


def test_every_anchor_is_kept():
    rng = np.random.default_rng(2)
    own, other, shared = ("".join(map(chr, rng.integers(97, 123, n))) for n in (100_000, 20_000, 300))
    long, short = own[:60_000] + shared + own[60_000:], other[:5000] + shared + other[5000:]
    (ids, places), other_sketch = syncmers.sketches([long, short])
    at, h = syncmers._anchors(np.frombuffer(long.encode("utf-32-le"), "<u4"))
    assert ids.tolist() == h.tolist() and places.tolist() == at.tolist()
    for sketch in ((ids, places), other_sketch, *syncmers.sketches(["", "short", "9" * 5000])):
        for x, y in zip(syncmers.unpacked(syncmers.fingerprint(sketch)), sketch, strict=True):
            assert x.tolist() == y.tolist()
    inside = len(syncmers.sketches([shared])[0][0])
    assert inside > 40 and syncmers._common(ids, other_sketch[0]) >= inside
    assert syncmers.likeness((ids, places), other_sketch) > 0
