"""As-of join and lag against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from strikeline.operators.ordered import SLICE, Slices, asof_join, previous_values, slices_of, with_slice

START = datetime(2024, 1, 1)
SCHEMA = "token string, ts timestamp_ntz"


def _at(second):
    return START + timedelta(seconds=second)


def _cut(df, count, hot_only):
    """``count`` slices of the hot key only, or of every key."""
    found = slices_of(df, ["token"], "ts", count)
    return found if hot_only else Slices(found.cuts)


def _skewed(rng, n, horizon):
    keys = ["hot"] * 6 + ["a", "b", "c"]
    return [(rng.choice(keys), rng.randrange(horizon)) for _ in range(n)]


@pytest.mark.parametrize("hot_only", [True, False])
@pytest.mark.parametrize("slices,forward", [(1, False), (7, False), (40, False), (7, True), (40, True)])
def test_asof_join(spark, slices, forward, hot_only):
    rng = random.Random(slices)
    quotes = [(k, t, rng.choice([0.0, 1.0, 2.5])) for k, t in _skewed(rng, 300, 400)]
    probes = [(i, k, t) for i, (k, t) in enumerate(_skewed(rng, 300, 450))]
    probes += [(900, "never", 5), (901, None, 5), (902, "hot", None)]

    def expected(k, t):
        if t is None:
            return None
        side = [(q, v) for kk, q, v in quotes if kk == k and (q >= t if forward else q <= t)]
        return (min(side) if forward else max(side))[1] if side else None

    q = spark.createDataFrame([(k, _at(t), v) for k, t, v in quotes], f"{SCHEMA}, ltp double")
    p = spark.createDataFrame(
        [(i, k, None if t is None else _at(t)) for i, k, t in probes], f"id int, {SCHEMA}"
    )
    both = q.select("token", "ts").unionByName(p.select("token", "ts"))
    cut = _cut(both, slices, hot_only)
    got = {r.id: r.ltp for r in asof_join(p, q, ["token"], "ts", ["ltp"], cut, forward).collect()}
    assert got == {i: expected(k, t) for i, k, t in probes}


def test_asof_without_quotes(spark):
    q = spark.createDataFrame([], f"{SCHEMA}, ltp double")
    p = spark.createDataFrame([(1, "a", _at(3))], f"id int, {SCHEMA}")
    assert [tuple(r) for r in asof_join(p, q, ["token"], "ts", ["ltp"]).collect()] == [
        (1, "a", _at(3), None)
    ]


@pytest.mark.parametrize("slices,hot_only", [(1, True), (5, True), (60, True), (60, False)])
def test_previous_values(spark, slices, hot_only):
    rng = random.Random(slices)
    rows = [(k, t, i, rng.random()) for i, (k, t) in enumerate(_skewed(rng, 400, 150))]
    df = spark.createDataFrame(
        [(k, _at(t), i, v) for k, t, i, v in rows], f"{SCHEMA}, id int, v double"
    )
    out = previous_values(
        df, ["token"], ["ts", "id"], {"v1": ("v", 1), "v2": ("v", 2)}, _cut(df, slices, hot_only)
    )
    assert out.columns == ["token", "ts", "id", "v", "v1", "v2"]
    got = {r.id: (r.v1, r.v2) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(ordered):
            want[r[2]] = tuple(ordered[n - k][3] if n >= k else None for k in (1, 2))
    assert got == want


def test_slices_split_a_hot_key(spark):
    df = spark.range(10_000).selectExpr(
        "'hot' AS token", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(id as int)) AS ts"
    )
    cut = slices_of(df, ["token"], "ts", 20)
    assert len(cut.hot) == 1
    sizes = [r["count"] for r in with_slice(df, ["token"], "ts", cut).groupBy(SLICE).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1500


def test_order_key_sorts_like_time_and_tie(spark):
    from strikeline.functions.ids import order_key

    rows = [(t, i) for t in ("1960-01-01 00:00:00", "2024-01-01 00:00:00.000001", "2024-01-01 00:00:00")
            for i in (None, -2**63, -1, 0, 1, 2**63 - 1)]
    df = spark.createDataFrame(rows, "t string, tie long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    by_key = df.orderBy(order_key(F.col("ts"), F.col("tie"))).collect()
    assert by_key == df.orderBy("ts", F.col("tie").asc_nulls_first()).collect()


@pytest.mark.parametrize("name", ["signal_log", "tick_bars"])
def test_newest_rows_need_no_sort(spark, name):
    from strikeline.queries import REGISTRY

    plan = REGISTRY[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_packed_rows_are_unpacked(spark):
    """What the newest snapshot of a minute says, rolled up before or after it is chosen."""
    from strikeline.operators import indicators as ind
    from strikeline.sources import driver_tables as dt

    snapshots = dt.snapshots(spark, DATA)
    got = ind.rollups_per_minute(snapshots)
    want = ind.rollup(ind.latest_per_minute(snapshots), ("symbol", "tf", "minute"))
    assert got.schema.names == want.select(*got.columns).schema.names
    want = want.select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.select("TA_SIGNAL").distinct().count() >= 6


def test_quotes_nobody_asks_for_are_not_moved(spark):
    from strikeline.operators.decisions import price_at

    start = datetime(2024, 1, 1)
    quotes = spark.createDataFrame(
        [(str(i), start, float(i)) for i in range(1000)] + [(None, start, 1.0)],
        "token string, ts timestamp_ntz, ltp double",
    )
    asked = spark.createDataFrame(
        [(1, "7", start), (2, None, start), (3, "7", None), (4, "none", start), (5, "11", start)],
        "id int, k string, at timestamp_ntz",
    )
    out = price_at(asked, quotes, "k", "at", "price", Slices())
    assert {r.id: r.price for r in out.collect()} == {1: 7.0, 2: None, 3: None, 4: None, 5: 11.0}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
