"""Truth tables of the vote rules: boundaries, nulls and NaN."""

import pytest
from pyspark.sql import functions as F

from strikeline.functions import votes
from strikeline.operators import indicators as ind
from strikeline.sources import driver_tables as dt
from tests.conftest import DATA

NAN = float("nan")
B, S, N, NONE = "BUY", "SELL", "NEUTRAL", None
RULES = {r.name: r for r in (*votes.COUNTED, *votes.UNCOUNTED)}

CASES = {
    "rsi_vote": [
        ((29, 28), B), ((30, 28), N), ((71, 72), S), ((70, 72), N), ((29, 29), N),
        ((None, 28), NONE), ((29, None), NONE), ((NAN, 28), N), ((80, NAN), N),
    ],
    "stoch_vote": [
        ((15, 10, 8, 9), B), ((90, 85, 86, 84), N), ((85, 90, 86, 84), S), ((20, 10, 8, 9), N),
        ((15, 10, 8, None), NONE), ((15, NAN, 8, 9), N), ((NAN, 90, 96, 94), N),
    ],
    "cci_vote": [((-101, -150), B), ((101, 150), S), ((-100, -150), N), ((101, NAN), N)],
    "adx_vote": [
        ((21, 20, 10, 5, 6), B), ((21, 10, 20, 6, 5), S), ((20, 20, 10, 5, 6), N),
        ((NAN, 20, 10, 5, 6), N), ((21, 20, 10, 5, None), NONE),
    ],
    "ao_vote": [
        ((1, -1, 0), B), ((2, 1, 3), B), ((-1, 1, 0), S), ((-2, -1, -3), S), ((0, 1, 1), N),
        ((1, -1, NAN), B), ((2, 1, NAN), N), ((1, -1, None), NONE),
    ],
    "mom_vote": [((2, 1), B), ((1, 2), S), ((1, 1), N), ((NAN, 1), N)],
    "macd_vote": [((2, 1), B), ((1, 2), S), ((1, 1), N)],
    "ema10_vote": [((2, 1), B), ((1, 2), S), ((1, 1), N), ((1, NAN), N), ((1, None), NONE)],
    "wr_vote": [((1,), B), ((-1,), S), ((0,), N), ((0.5,), N), ((None,), NONE), ((NAN,), N)],
    "bb_buy_vote": [((1, 2), B), ((2, 1), N)],
    "bb_sell_vote": [((2, 1), S), ((1, 2), N)],
    "psar_vote": [((2, 1), B), ((1, 2), S), ((1, 1), N)],
}


def _rows(spark, names, values):
    schema = "i int, " + ", ".join(f"`{n}` double" for n in names)
    rows = [
        (i, *[None if v is None else float(v) for v in vs]) for i, vs in enumerate(values)
    ]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(CASES))
def test_truth_table(spark, name):
    rule = RULES[name]
    values, expected = zip(*CASES[name])
    df = _rows(spark, rule.inputs, values)
    got = [r[name] for r in df.select("i", votes.vote(rule)).orderBy("i").collect()]
    assert got == list(expected)


def test_recommend_levels(spark):
    cases = {
        -1.0: "STRONG_SELL", -0.51: "STRONG_SELL", -0.5: "SELL", -0.11: "SELL", -0.1: N, 0.0: N,
        0.1: N, 0.11: B, 0.5: B, 0.51: "STRONG_BUY", 1.0: "STRONG_BUY", -1.01: "ERROR",
        1.01: "ERROR", NAN: "ERROR", None: None,
    }
    df = _rows(spark, ["score_all"], [(v,) for v in cases])
    got = df.select("i", votes.recommend("score_all").alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == list(cases.values())


def _snapshot(spark, **given):
    from strikeline import fixed

    names = list(fixed.SNAPSHOT_POSITIONS)
    filled = {n: 1.0 for n in names} | given
    return _rows(spark, names, [[filled[n] for n in names]])


def test_counts_match_the_labels(spark):
    snap = _snapshot(spark, rsi=29.0, rsi1=28.0, mom=1.0, mom1=2.0, rec_uo=None, close=2.0,
                     score_all=0.3)
    counts = ind.vote_counts(snap, ("i",)).first()
    labels = ind.votes_of(snap).first().asDict().values()
    for label in (B, S, N):
        assert counts[label] == sum(v == label for v in labels)
    assert sum(counts[x] for x in (B, S, N)) == 25
    long = ind.votes_long(snap, ("i",))
    assert long.count() == 25


@pytest.mark.parametrize("missing", ["score_other", "score_all", "score_ma", "close"])
def test_no_response(spark, missing):
    row = ind.rollup(_snapshot(spark, **{missing: None}), ("i",)).first()
    assert (row.no_response, row.TA_SIGNAL, row.FPRICE) == (True, "", 0.0)
    assert (row.OSCI, row.MA, row.BUY, row.SELL, row.NEUTRAL) == (None, None, 0, 0, 0)


def test_no_python_in_the_vote_plan(spark):
    plan = ind.rollup(_snapshot(spark), ("i",))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_totals_equal_the_counted_long_form(spark):
    snaps = dt.snapshots(spark, DATA)
    totals = ind.vote_totals(snaps, ("symbol", "tf"))
    counted = ind.votes_long(snaps, ("symbol", "tf")).groupBy(
        "symbol", "tf", "kind", "vote"
    ).agg(F.count("*").alias("n"))
    assert totals.exceptAll(counted).count() == 0 and counted.exceptAll(totals).count() == 0


def test_latest_per_minute_combines_before_the_shuffle(spark):
    plan = ind.latest_per_minute(dt.snapshots(spark, DATA))._jdf.queryExecution().toString()
    assert "partial_max_by" in plan
