"""Hard negatives against brute force, SQL and planted cases."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strikeline.llm import hard_negatives as hn
from strikeline.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, slice int"


def brute(rows, positives=5, negatives=10, low=30, high=90, scale=256.0):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(
            x is None or not math.isfinite(x) for x in v
        ):
            continue
        whole = [max(-2**24, min(2**24, math.floor(float(np.float32(x)) * scale))) for x in v]
        known[i] = min(known.get(i, (label, whole)), (label, whole))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for a in [i for i in known if i % 100 == 0]:
        scored = sorted((-dot(known[a][1], v), i, lab) for i, (lab, v) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == known[a][0]][:positives]:
            ps = -s
            fit = [
                x for x in scored
                if x[2] != known[a][0] and low * ps <= -100 * x[0] <= high * ps
            ][:negatives]
            out += [(a, p, r + 1, n, ps, -ns) for r, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def made(seed, n, dims=12, labels=4, spread=1.0, centres=6):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    rows = []
    for i in range(n):
        c = rng.choice(middle)
        rows.append((i * 10, [x + rng.gauss(0, spread) for x in c], rng.randrange(labels)))
    return rows


ODD = [
    (None, [1.0] * 12, 1), (7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 3, 2),
    (11, [float("inf")], 1), (12, [], 2), (13, [0.0] * 12, None), (14, [3e38] * 12, 1),
    (15, [-3e38] * 20, 2), (400, [], 3), (16, [0.5], 0), (0, [0.25] * 12, 1), (0, [0.25] * 12, 1),
    (0, [0.5] * 12, 0), (50, [0.25] * 12, 1), (51, [0.25] * 12, 2), (52, [0.25] * 12, 2),
    (500, [3e38] * 40, 1), (501, [3e38] * 40, 1), (502, [3e38] * 19 + [1.0] * 5, 2),
]


def frame(spark, rows, slices=3):
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], SCHEMA).repartition(slices)


def collected(df):
    return sorted(tuple(r) for r in df.select(*hn._RESULT).collect())


@pytest.mark.parametrize(("seed", "spread"), [(1, 1.0), (2, 0.05)])
def test_like_brute_force(spark, seed, spread):
    rows = made(seed, 300, spread=spread)
    assert collected(hn.mine(frame(spark, rows))) == brute(rows)


def test_odd_input(spark):
    rows = ODD + made(3, 40)
    want = brute(rows)
    assert any(abs(r[4]) > 2**53 for r in want)  # beyond exact doubles
    assert collected(hn.mine(frame(spark, rows))) == want
    assert hn.mine(frame(spark, [])).count() == 0
    assert hn.mine(frame(spark, [(1, [1.0], 1)])).count() == 0


def test_many_slices_and_other_numbers(spark, monkeypatch):
    monkeypatch.setattr(hn, "SLICE", 4)
    monkeypatch.setattr(hn, "AT_ONCE", 2)
    monkeypatch.setattr(hn, "BLOCK", 16)
    rows = made(4, 400, spread=0.3)
    got = hn.mine(frame(spark, rows), positives=3, negatives=4, low=10, high=95, scale=64.0)
    assert collected(got) == brute(rows, 3, 4, 10, 95, 64.0)


def test_spanning_tree_is_minimal_and_walked_parents_first():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (40, 6))
    parent, edge = hn.spanning_tree(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1).astype(float))
    joined, total, left = {0}, 0.0, set(range(1, 40))
    while left:  # grown edge by edge
        a, b = min(((i, j) for i in joined for j in left), key=lambda e: d[e])
        total += d[a, b]
        joined.add(b)
        left.remove(b)
    assert abs(edge.sum() - total) < 1e-6
    order = hn.walk_order(parent).tolist()
    assert sorted(order) == list(range(40))
    assert all(p < 0 or order.index(p) < order.index(i) for i, p in enumerate(parent.tolist()))


def test_bounds_spare_most_scores_where_anchors_are_near():
    """In tight clusters only rows near the window are scored, and none of these is missed."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (5, 16))
    anchors = np.concatenate([c + rng.normal(0, 0.01, (20, 16)) for c in centres])
    rows = np.concatenate([c + rng.normal(0, 0.01, (200, 16)) for c in centres])
    to_whole = lambda m: np.floor(256 * m).astype(np.int64)
    anchors, rows = to_whole(anchors), to_whole(rows)
    parent, edge = hn.spanning_tree(anchors)
    order = hn.walk_order(parent)
    place = {int(o): n for n, o in enumerate(order)}
    tree = hn.Tree([
        {"place": place[i], "above": place.get(int(parent[i]), -1), "edge": edge[i], "id": i,
         "label": 0, "v": anchors[i].tolist()} for i in range(100)
    ])
    batch = pa.RecordBatch.from_pydict({
        "id": np.arange(1000), "label": np.ones(1000, np.int64),
        "v": pa.array(rows.tolist(), pa.list_(pa.int32())),
    })
    block, scored = hn.Block(batch, 16), 0
    truth = tree.vectors @ rows.T
    least = np.quantile(truth, 0.9)
    for at, found, scores in hn.walk(tree, block, lambda _, low, high: high >= least):
        scored += len(found)
        assert np.array_equal(scores, truth[at][found])
        assert set(np.flatnonzero(truth[at] >= least)) <= set(found.tolist())
    assert scored < 0.3 * 100 * 1000


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = QUERIES["op12_anchor_tree_negatives"](spark, DATA)
    want = con.execute(ORACLES["op12_anchor_tree_negatives"]).fetchall()
    assert collected(got) == sorted(want)
