"""Streams over split files give the batch result."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.operators import decisions as dec
from strikeline.operators import indicators as ind
from strikeline.operators import instruments as ins
from strikeline.operators import trades as tr
from strikeline.operators.ordered import slices_of
from strikeline.plans import minute
from strikeline.session import shared_dir
from strikeline.sources import driver_tables as dt
from strikeline.sources import files
from strikeline.streaming.signals import (
    append_to,
    log_batch,
    logged_signals,
    signal_stream,
    unique_signals,
)
from strikeline.streaming.keyed import EVENT_SCHEMA, SPAN_MS, pack_quotes, trade_events
from strikeline.streaming.trades import STATE, trade_stream, trade_table
from tests.conftest import DATA


@pytest.fixture(scope="module")
def inputs(spark):
    """Events in three files in time order, arriving one file per micro-batch."""
    events = dt.read(spark, DATA, "events")
    folder = shared_dir(spark)
    for i, (low, high) in enumerate(((0, 350), (350, 700), (700, 10**9))):
        part = events.where(F.col("event_id").between(low, high - 1)).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/{i}")
    options = ins.of_type(dt.instrument_master(spark, DATA), fixed.OPTION_TYPE).cache()
    return events, folder, options


def _stream(spark, inputs):
    events, folder, _ = inputs
    return dt.snapshots_of(
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/*")
    )


def _batch_signals(spark, inputs):
    """Batch signals of the minutes a finished stream has emitted."""
    signals = minute.signals(dt.snapshots_of(inputs[0]))
    newest = dt.snapshots_of(inputs[0]).transform(
        lambda df: df.where("date_format(ts + interval 5 hours 30 minutes, 'HH:mm:ss') "
                            "between '09:15:00' and '15:25:00'")
    ).agg(F.max("ts")).first()[0]
    return signals.where(F.col("minute") <= F.lit(newest - timedelta(minutes=2)))


def test_signals_equal_batch(spark, inputs):
    path = shared_dir(spark)
    stream = signal_stream(_stream(spark, inputs))
    append_to(stream, f"{path}/t", f"{path}/c").awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{path}/t")
    want = _batch_signals(spark, inputs).select(*got.columns)
    assert got.count() > 100
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("loaded", [True, False])
def test_trades_equal_batch(spark, inputs, loaded):
    """``loaded``: the tables are read anew in each batch."""
    options, quotes = inputs[2], dt.quotes(spark, DATA)
    slices = slices_of(quotes, ["token"], "ts")
    path = shared_dir(spark)
    query = trade_stream(
        signal_stream(_stream(spark, inputs)), (lambda: options) if loaded else options,
        (lambda: dt.quotes(spark, DATA)) if loaded else quotes, path, f"{path}/c",
    )
    query.awaitTermination()
    table = trade_table(spark, path)
    closed = table.read().where("TRADE_STATUS = 'CLOSE'")
    assert len(table.numbers()) == 2  # older versions are pruned, and so is the state
    assert all(len(files.names(spark, f"{path}/{t}")) <= 2 for t in STATE)

    decided = dec.entry_decisions(
        dec.attach_daily_strikes(_batch_signals(spark, inputs), options), quotes, slices
    )
    pairs = tr.pair_trades(decided)
    settled = tr.settle_exits(pairs, decided, quotes, slices)
    want = tr.trade_rows(settled.where(F.col("exit_ts").isNotNull()))
    assert want.count() >= 5  # few days of this small table have listed strikes
    assert closed.exceptAll(want).count() == 0 and want.exceptAll(closed).count() == 0


def _keyed(spark, decided, quotes, options, path, files=1):
    """Events of decisions and quotes that lie below ``path``, so many files a micro-batch."""
    def stream(name, like):
        return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(
            f"{path}/{name}/*"
        )

    events = trade_events(stream("d", decided), stream("q", quotes), options)
    query = append_to(events, f"{path}/t", f"{path}/c")
    query.awaitTermination()
    return query, spark.read.schema(EVENT_SCHEMA).parquet(f"{path}/t").withColumn(
        "at", F.col("at").cast("timestamp_ntz")
    )


def test_keyed_state_equals_settled_trades(spark, inputs):
    """Three micro-batches, decisions and quotes a third each: what the batch job settles, up
    to the minute that both streams have passed."""
    options, quotes = inputs[2], dt.quotes(spark, DATA)
    slices = slices_of(quotes, ["token"], "ts")
    decided = dec.entry_decisions(
        dec.attach_daily_strikes(minute.signals(dt.snapshots_of(inputs[0])), options), quotes,
        slices,
    ).cache()
    path = shared_dir(spark)
    for i, days in enumerate(("< '2024-01-11'", "between '2024-01-11' and '2024-01-20'",
                              "> '2024-01-20'")):
        decided.where(f"date(minute) {days}").orderBy(F.rand(i)).coalesce(1).write.parquet(f"{path}/d/{i}")
        quotes.where(f"date(ts) {days}").orderBy(F.rand(i)).coalesce(1).write.parquet(f"{path}/q/{i}")
    query, events = _keyed(spark, decided, quotes, options, path)

    settled = tr.settle_exits(tr.pair_trades(decided), decided, quotes, slices)
    key = [*tr.KEY]
    want = settled.select(
        *key, F.lit("OPEN").alias("action"), F.col("entry.minute").alias("at"),
        F.col("entry.TA_SIGNAL").alias("signal"), F.col("entry.opt_token").alias("token"),
        F.col("entry.en_price").alias("price"),
    ).unionByName(
        settled.where("exit_ts IS NOT NULL").select(
            *key, F.lit("CLOSE").alias("action"), F.col("exit_ts").alias("at"),
            F.col("exit_signal").alias("signal"), F.col("entry.opt_token").alias("token"),
            F.col("exit_price").alias("price"),
        )
    )
    passed = min(
        decided.agg(F.max("minute")).first()[0], quotes.agg(F.max("ts")).first()[0]
    ) - timedelta(minutes=1)
    want = want.where(F.col("at") <= F.lit(passed))
    got = events.select(*want.columns)
    assert want.where("action = 'CLOSE'").count() >= 5
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # what is decided has left the state: at most the last day's quotes and the open trades
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal < 100


def _small(spark, steps, quoted, path, options="7"):
    day = datetime(2024, 1, 1, 5)
    decided = spark.createDataFrame(
        [("A", "1_MIN", day + timedelta(minutes=m), s, 1.0, ok, enter, "7", p)
         for m, s, ok, enter, p in steps],
        "symbol string, tf string, minute timestamp_ntz, TA_SIGNAL string, FPRICE double, "
        "strike_ok boolean, can_enter boolean, opt_token string, en_price double",
    )
    quotes = spark.createDataFrame(
        [("7", day + timedelta(minutes=m), p) for m, p in quoted],
        "token string, ts timestamp_ntz, ltp double",
    )
    decided.coalesce(1).write.parquet(f"{path}/d/0")
    quotes.coalesce(1).write.parquet(f"{path}/q/0")
    table = spark.createDataFrame([(options, "A")], "token string, name string")
    _, events = _keyed(spark, decided, quotes, table, path)
    return [(e.action, (e.at - day) // timedelta(minutes=1), e.price)
            for e in events.orderBy("at").collect()]


def test_keyed_state_needs_a_price_to_exit(spark):
    """No exit at a price of zero, null or NaN; an entry in between is not taken; the price is
    that of the last quote, from days before if there is none since."""
    far = (99_999, "NEUTRAL", False, False, None)  # moves the watermark on
    steps = [(0, "BUY", True, True, 5.0), (1, "SELL", True, False, None),
             (2, "BUY", True, True, 5.5), (3, "NEUTRAL", True, False, None),
             (4, "ERROR", True, False, None), (5, "SELL", False, False, None),
             (9, "NEUTRAL", True, False, None), (10, "BUY", True, True, 7.0),
             (3 * 1440, "SELL", True, False, None), far]
    quoted = [(0, 5.0), (1, 0.0), (3, None), (4, float("nan")), (6, 6.0), (9, 7.0), (99_999, 1.0)]
    got = _small(spark, steps, quoted, shared_dir(spark))
    assert got == [("OPEN", 0, 5.0), ("CLOSE", 9, 7.0), ("OPEN", 10, 7.0), ("CLOSE", 4320, 7.0)]


def test_keyed_state_takes_the_last_quote_of_the_days_between(spark):
    steps = [(0, "BUY", True, True, 5.0), (3000, "SELL", True, False, None),
             (99_999, "NEUTRAL", False, False, None)]
    quoted = [(2000, 9.0), (1999, 8.0), (3001, 1.0), (2000, 9.5), (99_999, 1.0)]
    got = _small(spark, steps, quoted, shared_dir(spark))
    assert got == [("OPEN", 0, 5.0), ("CLOSE", 3000, 9.5)]


def test_quotes_are_packed_by_symbol_and_span():
    import pyarrow as pa

    day = SPAN_MS * 1000
    batch = pa.RecordBatch.from_pydict({
        "symbol": ["A", "B", "A", "A"], "token": ["1", "2", "3", "1"],
        "time": [5, 6, day + 1, 7], "price": [1.0, 2.0, 3.0, 4.0],
    })
    rows = [r for b in pack_quotes(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    got = {(r["symbol"], r["time"]): pa.ipc.open_stream(r["rows"]).read_all().num_rows for r in rows}
    assert got == {("A", 7): 2, ("A", day + 1): 1, ("B", 6): 1}


def test_quotes_of_several_batches_are_packed_together():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"symbol": ["A", "B"], "token": ["1", "2"], "time": [5, 6], "price": [1.0, 2.0]}
    )
    rows = [r for b in pack_quotes(iter([batch] * 7)) for r in b.to_pylist()]
    assert [r["symbol"] for r in rows] == ["A", "B"]
    assert [pa.ipc.open_stream(r["rows"]).read_all().num_rows for r in rows] == [7, 7]


class _Map:
    """A map state that counts what is written to it."""

    def __init__(self):
        self.rows, self.written = {}, 0

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value
        self.written += sum(len(v) for v in value if isinstance(v, bytes))


def test_waiting_quotes_are_written_to_state_once():
    """However many chunks they come in, and not once more for every timeframe."""
    from types import SimpleNamespace

    import pandas as pd
    import pyarrow as pa

    from strikeline.streaming.keyed import TradeKeeper

    maps = {}
    keeper = TradeKeeper(tr.CLOSES)
    keeper.init(SimpleNamespace(
        getMapState=lambda name, *_: maps.setdefault(name, _Map()), registerTimer=lambda at: None
    ))
    batch = pa.RecordBatch.from_pydict({
        "symbol": ["A"] * 500, "token": ["1"] * 500, "time": list(range(500)), "price": [1.0] * 500,
    })
    [packed] = [r["rows"] for b in pack_quotes(iter([batch])) for r in b.to_pylist()]
    at = pd.Timestamp("2024-01-01 05:00")
    chunk = pd.DataFrame({"at": [at], "rows": [packed]})
    list(keeper.handleInputRows(("A", "1_MIN"), iter([chunk] * 20), None))
    assert maps["quotes"].written < 25 * len(packed)


def test_repeated_signals_are_dropped(spark):
    path = shared_dir(spark)
    schema = "symbol string, tf string, minute timestamp_ntz, n int"
    import datetime as d

    rows = [("A", "1_MIN", d.datetime(2024, 1, 1, 5, i // 2), 1) for i in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/d")
    stream = unique_signals(spark.readStream.schema(schema).parquet(f"{path}/d"))
    append_to(stream, f"{path}/t", f"{path}/c").awaitTermination()
    assert spark.read.schema(schema).parquet(f"{path}/t").count() == 3


def test_a_log_batch_counts_once_and_only_when_committed(spark, monkeypatch):
    root = shared_dir(spark)
    rows = ind.signal_log(minute.signals(dt.snapshots(spark, DATA))).limit(30).cache()
    first, second = rows.where("BUY % 2 = 0"), rows.where("BUY % 2 = 1")
    log_batch(first, 0, root)
    log_batch(first, 0, root)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(files, "create_whole", dies)
        with pytest.raises(RuntimeError):
            log_batch(second, 1, root)
    assert logged_signals(spark, root).count() == first.count()
    log_batch(second, 1, root)
    got = logged_signals(spark, root)
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0
    assert len(got.columns) == 14
