"""Snapshots stored by market day: what is read back, and what is not opened."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions import clock
from strikeline.operators import instruments as ins
from strikeline.session import shared_dir
from strikeline.sources.sessions import DAY, SECOND, read_sessions, write_sessions

OPENS, CLOSES = (timedelta(microseconds=clock.micros_of(t)) for t in (fixed.SESSION_OPEN, fixed.SESSION_CLOSE))
INDIA = timedelta(hours=5, minutes=30)


def _rows(spark):
    """Every seven minutes of five days, and the last instants of a session."""
    times = [datetime(2024, 1, 7, 20) + timedelta(minutes=7 * i) for i in range(1000)]
    times += [datetime(2024, 1, 9) + CLOSES - INDIA + timedelta(microseconds=m) for m in (-1, 0, 1, 10**6)]
    rows = [(i, t) for i, t in enumerate(times)] + [(-1, None)]
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz"), rows


@pytest.mark.parametrize("days", [None, [], [date(2024, 1, 9)], [date(2024, 1, 8), date(2024, 1, 10)]])
def test_read_back(spark, days):
    frame, rows = _rows(spark)
    path = shared_dir(spark)
    write_sessions(frame.where("id % 2 = 0"), path)
    write_sessions(frame.where("id % 2 <> 0"), path)
    got = read_sessions(spark, path, frame.schema, days)
    assert got.columns == ["id", "ts"]
    exact = got.where(clock.in_session(clock.local_time(F.col("ts"))))
    want = set()
    for i, t in rows:
        if t is not None:
            local = t + INDIA
            of_day = local - datetime.combine(local.date(), datetime.min.time())
            if OPENS <= of_day <= CLOSES and (days is None or local.date() in days):
                want.add(i)
    assert {r.id for r in exact.collect()} == want and len(want) == exact.count()
    # the stored hours are those hours, but for the rest of the last second
    assert 0 <= got.count() - len(want) <= 1


def test_other_days_and_hours_are_not_read(spark):
    path = shared_dir(spark)
    seconds = spark.range(0, 3 * 86_400, 2).select(
        "id", F.expr("timestamp_ntz'2024-01-07 18:30:00' + make_dt_interval(0, 0, 0, cast(id as int))").alias("ts")
    )
    write_sessions(seconds, path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = read_sessions(spark, path, seconds.schema, [date(2024, 1, 9)])
        rows = got.collect()
        plan = got._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    text = plan.toString()
    assert f"PartitionFilters: [isnotnull({DAY}" in text or f"PartitionFilters: [({DAY}" in text
    assert f"LessThanOrEqual({SECOND}" in text

    def scanned(node):
        children = node.children()
        if children.size() == 0:
            return node.metrics().apply("numOutputRows").value()
        return sum(scanned(children.apply(i)) for i in range(children.size()))

    a_day = 86_400 // 2
    assert len(rows) <= scanned(plan) < a_day  # one day's folder, and not all of its files


def test_a_day_with_most_rows_is_written_by_many(spark):
    path = shared_dir(spark)
    rows = spark.range(20_000).select(
        F.expr("timestamp_ntz'2024-01-08' + make_dt_interval(0, 0, 0, cast(id as int))").alias("ts")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows, one file
    try:
        write_sessions(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(r["count"] for r in files) < 15_000


def test_open_days(spark):
    calendar = spark.createDataFrame(
        [(date(2024, 1, 8), "NO"), (date(2024, 1, 9), "YES"), (date(2024, 1, 13), "YES")],
        "day date, market_open_status string",
    )
    days = [r.day for r in ins.open_days(calendar, "2024-01-05", "2024-01-14").orderBy("day").collect()]
    assert days == [date(2024, 1, d) for d in (5, 9, 10, 11, 12)]
