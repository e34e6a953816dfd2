from datetime import date, datetime

from pyspark.sql import functions as F

from strikeline.functions import clock, ids, strikes


def test_strikes_round_and_trunc(spark):
    cases = {
        44512.3: (44500, 44500), 44999.4: (44900, 44900), 44999.5: (45000, 44900),
        44899.5: (44900, 44800), 44998.5: (44900, 44900), 0.5: (0, 0), 0.0: (0, 0),
        -150.5: (-100, -100),
    }
    df = spark.createDataFrame([(k,) for k in cases], "p double").select(
        "p", strikes.call_strike(F.col("p")).alias("r"),
        strikes.call_strike(F.col("p"), "trunc").alias("t"),
        strikes.put_strike(strikes.call_strike(F.col("p"))).alias("put"),
    )
    for row in df.collect():
        assert (row.r, row.t) == cases[row.p]
        assert row.put == row.r + 100


def test_strikes_from_text(spark):
    cases = {"44512": (44500, 44600), "44512.5": (0, 0), "abc": (0, 0), "": (0, 0), None: (0, 0)}
    call, put = strikes.strikes_from_text(F.col("p"))
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", call, put)
    for p, c, q in df.collect():
        assert (c, q) == cases[p]


def test_strike_from_hundredths(spark):
    df = spark.createDataFrame([("4450000.000000",), ("-1.000000",), ("x",)], "s string")
    got = [r[0] for r in df.select(strikes.strike_from_hundredths(F.col("s"))).collect()]
    assert got == [44500, 0, None]


def test_session_edges(spark):
    local = ["09:14:59.999999", "09:15:00", "15:15:00", "15:20:00", "15:25:00", "15:25:00.000001"]
    df = spark.createDataFrame([(f"2024-01-10 {t}",) for t in local], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t")
    )
    got = df.select(
        clock.in_session(F.col("t")), clock.stop_entry(F.col("t")), clock.close_all(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, False, False), (True, False, False), (True, True, False), (True, True, True),
        (True, True, True), (False, True, True),
    ]


def test_local_time_and_expiry(spark):
    row = spark.range(1).select(
        clock.local_time(F.lit("2024-01-10 20:00:00").cast("timestamp_ntz")).alias("l"),
        clock.parse_expiry(F.lit("28DEC2023")).alias("e"),
        clock.parse_expiry(F.lit("")).alias("none"),
        clock.format_expiry(F.lit("2023-12-28").cast("date")).alias("text"),
    ).first()
    assert row.l == datetime(2024, 1, 11, 1, 30)
    assert (row.e, row.none, row.text) == (date(2023, 12, 28), None, "28DEC2023")


def test_freshness_is_strict(spark):
    stamps = ["2024-01-10 09:07:00", "2024-01-10 09:07:01", "2024-01-09 10:00:00", None]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    fresh = clock.is_fresh(F.col("s").cast("timestamp_ntz"), F.lit("2024-01-10").cast("date"))
    assert [r[0] for r in df.select(fresh).collect()] == [False, True, False, False]


def test_ids_are_stable(spark):
    row = spark.sql("SELECT 'A' s, '1_MIN' t, timestamp_ntz'2024-01-10 04:00:00' m")
    ids_of = lambda: row.select(
        ids.cycle_id(F.col("s"), F.col("m")), ids.signal_id(F.col("s"), F.col("t"), F.col("m"))
    ).first()
    assert ids_of() == ids_of()
    assert len(set(ids_of())) == 2
