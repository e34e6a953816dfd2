from datetime import date

from pyspark.sql import functions as F

from strikeline import fixed, schemas
from strikeline.functions import strikes
from strikeline.operators import instruments as ins
from strikeline.plans import daily

AS_OF = "2023-12-20"


def _row(token, symbol, expiry, strike="-1", kind="OPTIDX", name="IDX", seg="NFO"):
    return (token, symbol, name, expiry, strike, kind, seg)


MASTER = [
    _row("1", "IDX28DEC23FUT", "28DEC2023", kind="FUTIDX"),
    _row("0", "IDX28DEC23FUTB", "28DEC2023", kind="FUTIDX"),
    _row("2", "IDX30NOV23FUT", "30NOV2023", kind="FUTIDX"),
    _row("3", "OTHFUT", "25JAN2024", kind="FUTIDX", name="OTH"),
    _row("4", "EQ", "", kind="", seg="NSE"),
    _row("10", "IDX20DEC2344500CE", "20DEC2023", "4450000.000000"),
    _row("11", "IDX20DEC2344600PE", "20DEC2023", "4460000.000000"),
    _row("12", "IDX20DEC2344500CE2CE", "20DEC2023", "4450000.000000"),
    _row("13", "IDX27DEC2344500CE", "27DEC2023", "4450000.000000"),
    _row("14", "IDX13DEC2344500CE", "13DEC2023", "4450000.000000"),
    _row("15", "IDXBAD", "", "4450000.000000"),
    _row("16", "IDX20DEC2346000CE", "20DEC2023", "4600000.000000"),
    _row("17", "IDX20DEC2345600PE", "20DEC2023", "4560000.000000"),
]


def _master(spark):
    return spark.createDataFrame(MASTER, schemas.INSTRUMENT_MASTER)


def test_current_future_and_expiry(spark):
    futures = ins.of_type(_master(spark), fixed.FUTURE_TYPE)
    got = {r.name: tuple(r)[1:] for r in ins.current_future(futures, AS_OF).collect()}
    assert got["IDX"] == (date(2023, 12, 28), "0", "IDX28DEC23FUTB")
    assert got["OTH"][1] == "3"
    options = ins.of_type(_master(spark), fixed.OPTION_TYPE, ["IDX"])
    assert ins.current_option_expiry(options, AS_OF).first().opt_expiry == date(2023, 12, 20)
    assert ins.current_option_expiry(options, "2023-12-21").first().opt_expiry == date(2023, 12, 27)
    assert [r.token for r in ins.unreadable_expiries(options).collect()] == ["15"]


def test_chain_follows_the_day(spark):
    """Each day has the chain of the nearest expiry not before it, if there is one."""
    options = ins.of_type(_master(spark), fixed.OPTION_TYPE)
    rows = options.select("name", "expiry_date").where("expiry_date is not null").distinct().collect()
    by_name = {}
    for r in rows:
        by_name.setdefault(r.name, []).append(r.expiry_date)
    days = [(n, e) for n, es in by_name.items() for e in es]
    days += [(n, max(es).replace(year=max(es).year + 1)) for n, es in by_name.items()]
    chain = ins.chain_of_days(
        options, spark.createDataFrame(days, "name string, session_date date")
    ).collect()
    assert chain and all(r.expiry == r.session_date for r in chain)
    late = {max(es).replace(year=max(es).year + 1) for es in by_name.values()}
    assert not late & {r.session_date for r in chain}
    one = ins.ladder(ins.chain_of_days(
        options, spark.createDataFrame(days[:1], "name string, session_date date")
    ))
    assert "session_date" in one.columns


def test_prices_that_are_none(spark):
    prices = [float("nan"), None, 0.0, -5.0, float("inf"), 44512.3]
    got = spark.createDataFrame([(p,) for p in prices], "p double").select(
        strikes.usable(F.col("p")).alias("u"), strikes.call_strike(F.col("p")).alias("r"),
        strikes.call_strike(F.col("p"), mode="trunc").alias("t"),
        strikes.strike_from_hundredths(F.lit("NaN")).alias("h"),
    ).collect()
    assert [r.u for r in got] == [False, False, False, False, True, True]
    assert [r.r for r in got] == [None, None, 0, 0, None, 44500] == [r.t for r in got]
    assert got[0].h is None


def test_chain_band_and_ladder(spark):
    chain = ins.option_chain(ins.of_type(_master(spark), fixed.OPTION_TYPE), AS_OF)
    assert {r.token for r in chain.collect()} == {"10", "11", "12", "16", "17"}
    prices = spark.createDataFrame([("IDX", 44599.5)], "name string, price double")
    # calls 43500…45500, puts 43600…45600
    assert {r.token for r in ins.in_band(chain, prices).collect()} == {"10", "11", "12", "17"}
    nothing = spark.createDataFrame([("IDX", 0.0)], "name string, price double")
    assert ins.in_band(chain, nothing).count() == 0
    ladder = {r.CSP: (r.ce_token, r.pe_token) for r in ins.ladder(chain).collect()}
    assert ladder[44500] == ("10", "11") and ladder[46000] == ("16", None)


def test_market_open(spark):
    calendar = spark.createDataFrame(
        [("2024-01-06", "YES"), ("2024-01-08", "NO"), ("2024-01-09", "YES")],
        "day string, market_open_status string",
    ).select(F.col("day").cast("date").alias("day"), "market_open_status")
    days = spark.createDataFrame(
        [("2024-01-06",), ("2024-01-08",), ("2024-01-09",), ("2024-01-10",)], "day string"
    ).select(F.col("day").cast("date").alias("day"))
    status = {r.day.day: r.market_is_open for r in ins.day_status(days, calendar).collect()}
    assert status == {6: "NO", 8: "NO", 9: "YES", 10: "YES"}
    empty = ins.day_status(days, calendar.where("false"))
    assert {r.day.day: r.market_is_open for r in empty.collect()} == {
        6: "NO", 8: "YES", 9: "YES", 10: "YES"
    }


def test_daily_job_stores_and_reads_back(spark, tmp_path):
    from strikeline.sources import readers

    calendar = spark.createDataFrame([], "day date, market_open_status string")
    prices = spark.createDataFrame([("IDX", 44599.5)], "name string, price double")
    data = daily.daily_data(
        _master(spark), calendar, prices, AS_OF, F.lit("2023-12-20 09:10:00"), ["IDX"]
    )
    root = str(tmp_path)
    daily.store(data, root)
    daily.store(data, root)  # a second run replaces, it does not add
    config = readers.trading_config(spark, f"{root}/config/current").first()
    assert (config.FUT_TOKEN, config.OPT_EXPIRY_DATE_STR) == ("0", "20DEC2023")
    puts = readers.option_chain(spark, f"{root}/chain", "2023-12-20", "PE")
    assert [r.strike for r in puts.orderBy("strike").collect()] == [44600, 45600]
    assert all(r.passed for r in data.checks.collect())
    plan = puts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(expiry" in plan


def test_expiry_status_and_touch(spark):
    config = spark.sql(
        "SELECT date'2023-12-28' FUT_EXPIRY_DATE, date'2023-12-20' OPT_EXPIRY_DATE, "
        "date'2023-12-01' T_DATE, 'MAIN' ke"
    )
    row = ins.expiry_status(config, "2023-12-21").first()
    assert (row.fut_valid, row.opt_valid) == (True, False)
    assert ins.touch_config(config, "MAIN", AS_OF).first().T_DATE == date(2023, 12, 20)
    assert ins.touch_config(config, "X", AS_OF).first().T_DATE == date(2023, 12, 1)
