"""Set-based trades against a row-by-row loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.operators import trades as tr
from strikeline.operators.ordered import slices_of

OPEN_AT = datetime(2024, 1, 10, 4, 0)
SCHEMA = (
    "symbol string, tf string, minute timestamp_ntz, session_date date, TA_SIGNAL string, "
    "FPRICE double, C_NUM int, strike_ok boolean, can_enter boolean, opt_token string"
)
SIGNALS = [*fixed.TRADABLE, "NEUTRAL", "ERROR", fixed.CLOSE_ALL, ""]


def _decision(symbol, tf, minute, signal, strike_ok=True, entry_ok=True, token="t"):
    can = strike_ok and entry_ok and signal in fixed.TRADABLE
    return (symbol, tf, minute, minute.date(), signal, 1.0, 1, strike_ok, can, token)


def _loop(rows, price=None):
    """The trading loop: close against the signal, then enter, on the open trades as they
    were when the minute began."""
    done = []
    for key in sorted({r[:2] for r in rows}):
        held = {}
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            _, _, minute, _, signal, _, _, strike_ok, can_enter, token = r
            if not strike_ok:
                continue
            before = dict(held)
            for x, (entered, tok) in before.items():
                if x in tr.CLOSES.get(signal, ()):
                    if price is None or price(tok, minute) > 0:
                        done.append((*key, x, entered, minute, signal))
                        del held[x]
            if can_enter and signal not in before:
                held[signal] = (minute, token)
        done += [(*key, x, entered, None, None) for x, (entered, _) in held.items()]
    return sorted(done, key=str)


def _got(pairs):
    rows = pairs.select(*tr.KEY, "entry.minute", "exit_ts", "exit_signal").collect()
    return sorted((tuple(r) for r in rows), key=str)


def _random_rows(seed, minutes=300, gap=40):
    rng = random.Random(seed)
    rows = []
    for symbol in ("A", "B"):
        for tf in ("1_MIN", "5_MIN"):
            at = OPEN_AT
            for _ in range(minutes):
                at += timedelta(minutes=rng.randint(1, gap))
                rows.append(_decision(
                    symbol, tf, at, rng.choice(SIGNALS), rng.random() > 0.1, rng.random() > 0.2,
                    rng.choice(["t1", "t2", "t3"]),
                ))
    return rows


@pytest.mark.parametrize("seed,gap", [(1, 2), (2, 40), (3, 2000)])
def test_random_signals_match_the_loop(spark, seed, gap):
    rows = _random_rows(seed, gap=gap)
    pairs = tr.pair_trades(spark.createDataFrame(rows, SCHEMA))
    assert _got(pairs) == _loop(rows)


def _sequence(*steps):
    return [
        _decision("A", "1_MIN", OPEN_AT + timedelta(minutes=i + 1), s, *rest)
        for i, (s, *rest) in enumerate(steps)
    ]


@pytest.mark.parametrize("steps,expected", [
    ([("BUY",), ("BUY",), ("SELL",)], [("BUY", 1, 3, "SELL"), ("SELL", 3, None, None)]),
    ([("BUY",), ("STRONG_BUY",), ("NEUTRAL",)],
     [("BUY", 1, 3, "NEUTRAL"), ("STRONG_BUY", 2, 3, "NEUTRAL")]),
    ([("SELL",), ("", False), ("STRONG_BUY",)],
     [("SELL", 1, 3, "STRONG_BUY"), ("STRONG_BUY", 3, None, None)]),
    ([("BUY",), ("ERROR",), ("BUY",)], [("BUY", 1, 2, "ERROR"), ("BUY", 3, None, None)]),
    ([("BUY",), ("SELL", False), ("SELL",)],
     [("BUY", 1, 3, "SELL"), ("SELL", 3, None, None)]),
    ([("BUY",), ("SELL", True, False), (fixed.CLOSE_ALL,)], [("BUY", 1, 2, "SELL")]),
])
def test_sequences(spark, steps, expected):
    pairs = tr.pair_trades(spark.createDataFrame(_sequence(*steps), SCHEMA))
    at = lambda n: None if n is None else OPEN_AT + timedelta(minutes=n)
    want = [("A", "1_MIN", x, at(i), at(o), s) for x, i, o, s in expected]
    assert _got(pairs) == sorted(want, key=str)


def test_strike_gate_is_optional(spark):
    rows = _sequence(("BUY",), (fixed.CLOSE_ALL, False))
    df = spark.createDataFrame(rows, SCHEMA)
    assert _got(tr.pair_trades(df))[0][4] is None
    assert _got(tr.pair_trades(df, exit_requires_strike=False))[0][5] == fixed.CLOSE_ALL


def test_carried_trades_continue(spark):
    rows = _random_rows(5, gap=60)
    cut = OPEN_AT + timedelta(days=2, hours=3)
    whole = _got(tr.pair_trades(spark.createDataFrame(rows, SCHEMA)))
    first = tr.pair_trades(spark.createDataFrame([r for r in rows if r[2] < cut], SCHEMA))
    later = tr.pair_trades(
        spark.createDataFrame([r for r in rows if r[2] >= cut], SCHEMA),
        carried=first.where(F.col("exit_ts").isNull()),
    )
    closed_first = _got(first.where(F.col("exit_ts").isNotNull()))
    assert sorted(closed_first + _got(later), key=str) == whole


@pytest.mark.parametrize("seed,gap", [(11, 3), (12, 50)])
def test_failed_exits_are_retried(spark, seed, gap):
    rng = random.Random(seed)
    rows = _random_rows(seed, minutes=150, gap=gap)
    horizon = int((max(r[2] for r in rows) - OPEN_AT).total_seconds() // 60)
    quotes = {
        (tok, OPEN_AT + timedelta(minutes=rng.randrange(horizon))): rng.choice([0.0, 0.0, 5.0])
        for tok in ("t1", "t2", "t3") for _ in range(60)
    }

    def price(token, minute):
        known = [(at, p) for (tok, at), p in quotes.items() if tok == token and at <= minute]
        return max(known)[1] if known else 0.0

    q = spark.createDataFrame(
        [(tok, at, p) for (tok, at), p in quotes.items()], "token string, ts timestamp_ntz, ltp double"
    )
    decided = spark.createDataFrame(rows, SCHEMA)
    settled = tr.settle_exits(tr.pair_trades(decided), decided, q, slices_of(q, ["token"], "ts", 5))
    want = _loop(rows, price)
    assert _got(settled) == want
    assert want != _loop(rows)
    for r in settled.where(F.col("exit_ts").isNotNull()).select(
        "entry.opt_token", "exit_ts", "exit_price"
    ).collect():
        assert r.exit_price == price(r.opt_token, r.exit_ts)


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_the_number_of_drop_outs_does_not_matter(spark):
    """A price that comes and goes between the closings: as many jobs for 60 times as for 4."""
    jobs = set()
    for n in (4, 60):
        rows = _sequence(("BUY",), *[("NEUTRAL",)] * n)
        quotes = [("t", OPEN_AT, 1.0)]
        for i in range(2, n + 1):  # zero at each closing but the last, usable just before it
            at = OPEN_AT + timedelta(minutes=i)
            quotes += [("t", at - timedelta(seconds=30), 2.0), ("t", at, 0.0)]
        quotes += [("t", OPEN_AT + timedelta(minutes=n + 1), 3.0)]
        decided = spark.createDataFrame(rows, SCHEMA).cache()
        q = spark.createDataFrame(quotes, "token string, ts timestamp_ntz, ltp double")
        pairs = tr.pair_trades(decided)
        settled, count = _jobs(spark, f"settle {n}", lambda: tr.settle_exits(
            pairs, decided, q, slices_of(q, ["token"], "ts")  # noqa: B023
        ).collect())
        jobs.add(count)
        got = [(r.exit_ts, r.exit_price) for r in settled]
        assert got == [(OPEN_AT + timedelta(minutes=n + 1), 3.0)]
    assert len(jobs) == 1


def test_pairing_shuffles_are_per_day_or_edges(spark):
    df = spark.createDataFrame(_sequence(("BUY",)), SCHEMA)
    plan = tr.pair_trades(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2
    assert "session_date" in exchanges[1] and "within" in exchanges[0]


def test_close_rule_table(spark):
    table = tr.close_rules(spark)
    assert table.count() == 24
    both = table.select(tr.closes(F.col("signal"), F.col("closes"))).distinct().collect()
    assert [r[0] for r in both] == [True]
