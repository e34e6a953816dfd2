import json
from datetime import date, datetime

from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.sources import driver_tables as dt
from strikeline.sources import readers, writers
from tests.conftest import DATA


def test_json_instruments_and_csv_calendar(spark, tmp_path):
    records = [{"token": "1", "symbol": "XCE", "name": "X", "expiry": "", "strike": "100.0",
                "instrumenttype": "OPTIDX", "exch_seg": "NFO", "lotsize": "15"}]
    (tmp_path / "master.json").write_text(json.dumps(records, indent=1))
    master = readers.instrument_master(spark, str(tmp_path / "master.json"))
    assert master.first().strike == "100.0" and "lotsize" not in master.columns

    (tmp_path / "days.csv").write_text("date,market_open_status\n26-01-2024,NO\nbad,YES\n")
    days = readers.calendar(spark, str(tmp_path / "days.csv")).collect()
    assert [(r.day, r.market_open_status) for r in days] == [(date(2024, 1, 26), "NO"), (None, "YES")]


def test_config_text(spark):
    df = spark.createDataFrame(
        [('{"FUT_TOKEN":"7","UPDATED_DATE_TIME":"2024-01-10 09:30:00"}',), ("{",)], "doc string"
    )
    good, bad = readers.trading_config_from_text(df, "doc").collect()
    assert (good.FUT_TOKEN, good.UPDATED_DATE_TIME) == ("7", datetime(2024, 1, 10, 9, 30))
    assert bad.FUT_TOKEN is None


def test_array_payload_equals_named_columns(spark):
    named = dt.snapshots(spark, DATA)
    unpacked = readers.snapshots_from_arrays(dt.scanner_arrays(spark, DATA))
    assert unpacked.columns == named.columns
    assert unpacked.exceptAll(named).count() == 0


def test_extra_payload_values_and_short_payloads(spark):
    df = spark.createDataFrame(
        [("a", [float(i) for i in range(93)]), ("b", [1.0, 2.0])], "symbol string, d array<double>"
    )
    a, b = readers.snapshots_from_arrays(df, extra=["x", "y"]).collect()
    assert (a.score_all, a.ao2, a.x, a.y) == (1.0, 86.0, 91.0, 92.0)
    assert (b.score_all, b.rsi, b.y) == (2.0, None, None)


def test_wide_feed(spark):
    cols = ["symbol", "ts", "close|5", "RSI|5", "close", "RSI"]
    df = spark.createDataFrame(
        [("abc", datetime(2024, 1, 1), 1.0, 2.0, 3.0, 4.0)],
        "symbol string, ts timestamp_ntz, `close|5` double, `RSI|5` double, close double, RSI double",
    )
    assert df.columns == cols
    rows = {r.tf: r for r in readers.snapshots_from_wide(df).collect()}
    assert set(rows) == {"5_MIN", "1_DAY"}
    assert (rows["5_MIN"].symbol, rows["5_MIN"].rsi, rows["1_DAY"].close) == ("ABC", 2.0, 3.0)
    assert rows["1_DAY"].mom is None


def test_feed_columns_default_to_one_day():
    assert readers.feed_columns("15m", ["RSI"]) == ["RSI|15"]
    assert readers.feed_columns("oops", ["RSI"]) == ["RSI"]
    assert len(fixed.SCANNER_COLUMNS) == 91


def test_matching_is_typed_and_pushed_down(spark):
    df = readers.matching(dt.read(spark, DATA, "orders"), o_orderstatus="O' OR '1'='1")
    assert df.count() == 0
    plan = readers.matching(dt.read(spark, DATA, "orders"), o_orderstatus="O").select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_append_with_computed_columns(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    path = str(tmp_path / "t")
    for _ in range(2):
        writers.append_rows(df, path, {"CRE_DATIME": F.current_timestamp()})
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and all(r.CRE_DATIME is not None for r in rows)


def test_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for fmt in ("orc", "json", "parquet"):
        writers.write_table(df, str(tmp_path / fmt), fmt=fmt)
        back = readers.table(spark, str(tmp_path / fmt), fmt)
        assert sorted((r.k, r.v) for r in back.collect()) == [(1, "a"), (2, "b")]
    writers.write_csv(df, str(tmp_path / "csv"))
    assert readers.table(spark, str(tmp_path / "csv"), "csv", header="true").count() == 2
