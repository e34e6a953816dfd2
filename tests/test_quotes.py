"""Lookups in the quote store against brute force, and what they read and move."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strikeline.session import shared_dir
from strikeline.sources.quotes import QuoteStore, stored_quotes

START = datetime(2023, 12, 31, 22)
QUOTE = "token string, ts timestamp_ntz, ltp double"


def _at(second):
    return None if second is None else START + timedelta(seconds=second)


def _quotes(rng, n):
    """Quotes of nearly five days; one token has two thirds of them, some have no price."""
    keys = ["hot"] * 4 + ["a", "b"]
    return [
        (rng.choice(keys), rng.randrange(0, 400_000, 50), rng.choice([0.0, 1.0, 2.5, None]))
        for _ in range(n)
    ]


def _frame(spark, quotes):
    return spark.createDataFrame([(k, _at(t), v) for k, t, v in quotes], QUOTE)


def _expected(quotes, token, t):
    if token is None or t is None:
        return None
    side = [(q, v is not None, v or 0.0) for k, q, v in quotes if k == token and q <= t]
    return (lambda best: best[2] if best[1] else None)(max(side)) if side else None


@pytest.mark.parametrize("slot_minutes", [15, 1440])
def test_lookup(spark, slot_minutes):
    rng = random.Random(slot_minutes)
    quotes = _quotes(rng, 500)
    store = stored_quotes(
        _frame(spark, quotes + [(None, 5, 1.0), ("a", None, 1.0)]), shared_dir(spark), 3, slot_minutes
    )
    probes = [(i, k, t) for i, (k, t, _) in enumerate(_quotes(rng, 400))]
    probes += [(900, "never", 5), (901, None, 5), (902, "hot", None), (903, None, None),
               (904, "hot", -1), (905, "hot", 10_000_000)]
    asked = spark.createDataFrame([(i, k, _at(t)) for i, k, t in probes], "id int, k string, at timestamp_ntz")
    out = store.price_at(asked, "k", "at", "price")
    assert out.columns == ["id", "k", "at", "price"]
    assert {r.id: r.price for r in out.collect()} == {i: _expected(quotes, k, t) for i, k, t in probes}


def test_later_loads_and_repeats(spark):
    rng = random.Random(3)
    quotes, path = _quotes(rng, 300), shared_dir(spark)
    store = stored_quotes(_frame(spark, quotes[:100]), path, 2)
    store.append(_frame(spark, quotes[100:]))
    store.append(_frame(spark, quotes[100:]))  # a load that was repeated
    probes = [(i, k, t) for i, (k, t, _) in enumerate(_quotes(rng, 200))]
    asked = spark.createDataFrame([(i, k, _at(t)) for i, k, t in probes], "id int, token string, ts timestamp_ntz")
    again = QuoteStore.open(spark, path)
    assert (again.buckets, again.slot_minutes) == (2, 60)
    got = {r.id: r.ltp for r in again.price_at(asked, "token", "ts", "ltp").collect()}
    assert got == {i: _expected(quotes, k, t) for i, k, t in probes}


def test_a_load_that_lacks_the_small_table_is_repeated(spark, monkeypatch):
    path = shared_dir(spark)
    store = stored_quotes(_frame(spark, [("a", 0, 1.0)]), path, 2)
    late = _frame(spark, [("a", 100_000, 2.0)])
    closes = store._closes
    monkeypatch.setattr(store, "_closes", "no_such_table")
    with pytest.raises(Exception, match="no_such_table"):
        store.append(late)
    monkeypatch.setattr(store, "_closes", closes)
    asked = spark.createDataFrame([("a", _at(200_000))], "token string, ts timestamp_ntz")
    price = lambda: QuoteStore.open(spark, path).price_at(asked, "token", "ts", "p").first().p
    assert price() == 1.0
    store.append(late)
    assert price() == 2.0


def test_empty(spark):
    store = stored_quotes(_frame(spark, []), shared_dir(spark), 2)
    asked = spark.createDataFrame([("a", _at(3))], "token string, ts timestamp_ntz")
    assert [tuple(r) for r in store.price_at(asked, "token", "ts", "ltp").collect()] == [
        ("a", _at(3), None)
    ]
    assert store.price_at(asked.limit(0), "token", "ts", "ltp").count() == 0


def test_layout_is_checked(spark):
    with pytest.raises(ValueError):
        QuoteStore.create(spark, shared_dir(spark), 2, 7)


def test_quotes_are_not_shuffled_and_other_days_not_read(spark):
    quotes = _quotes(random.Random(5), 300)
    store = stored_quotes(_frame(spark, quotes), shared_dir(spark), 4)
    asked = _frame(spark, quotes).select("token", "ts", F.lit(1).alias("x"))
    out = store.price_at(asked, "token", "ts", "ltp", None, "2024-01-02", "2024-01-02")
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if store._quotes in line)
    assert "Bucketed: true" in plan[scan]
    assert re.search(r"PartitionFilters: \[.*day.*2024-01-02", plan[scan])
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    above, at = [], depth(plan[scan])
    for line in reversed(plan[:scan]):
        if re.search(r"[A-Za-z]", line) and depth(line) < at:
            above.append(line)
            at = depth(line)
    assert any("Window" in line for line in above)
    assert not any("Exchange" in line for line in above)
    # rows of the day get what they get from all days
    day = F.col("ts").cast("date") == F.lit("2024-01-02").cast("date")
    whole = store.price_at(asked, "token", "ts", "ltp")
    one, every = (sorted(map(str, df.where(day).collect())) for df in (out, whole))
    assert one == every and one


def test_a_hot_token_lies_in_all_files(spark):
    rows = [("hot", t, 1.0) for t in range(0, 86_400, 60)]
    store = stored_quotes(_frame(spark, rows), shared_dir(spark), 4, 15)
    placed = spark.table(store._quotes).groupBy(F.input_file_name()).count().collect()
    by_bucket = {}
    for name, n in placed:
        bucket = re.search(r"_(\d{5})\.", name).group(1)
        by_bucket[bucket] = by_bucket.get(bucket, 0) + n
    assert len(by_bucket) == 4 and max(by_bucket.values()) < len(rows) / 2


def test_a_load_reads_its_quotes_once(spark):
    rows = [("a", _at(t), float(t)) for t in range(0, 300_000, 3000)]
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    store = QuoteStore.create(spark, shared_dir(spark), 2)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store.append(spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), QUOTE))
    assert read.value == len(rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert sorted(map(tuple, store.read().collect())) == rows


def test_stored_quotes_nobody_asks_for_are_left_out_as_they_are_read(spark):
    quotes = [(str(i), 0, float(i)) for i in range(100)]
    store = stored_quotes(_frame(spark, quotes), shared_dir(spark), 2)
    asked = _frame(spark, [("7", 60, None), ("none", 60, None)]).drop("ltp")
    out = store.price_at(asked, "token", "ts", "price")
    assert {r.token: r.price for r in out.collect()} == {"7": 7.0, "none": None}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
