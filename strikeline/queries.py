"""Every registered query: a function of (spark, sf_dir) over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strikeline import fixed, schemas
from strikeline.functions import clock, ids, strikes, votes
from strikeline.operators import bars as bar_ops
from strikeline.operators import decisions as dec
from strikeline.operators import indicators as ind
from strikeline.operators import instruments as ins
from strikeline.operators import logs, quality
from strikeline.operators import trades as tr
from strikeline.operators.ordered import asof_join, slices_of
from strikeline.plans import daily, minute, validation
from strikeline.session import cut_lineage, prepare, shared_dir
from strikeline.sources import driver_tables as dt
from strikeline.sources import readers, writers
from strikeline.sources.quotes import QuoteStore, stored_quotes
from strikeline.sources.sessions import read_sessions, write_sessions
from strikeline.sources.versions import VersionedTable, trade_part
from strikeline.streaming.keyed import EVENT_SCHEMA, trade_events
from strikeline.streaming.signals import (
    append_to,
    log_batch,
    log_signals,
    logged_signals,
    signal_stream,
    unique_signals,
)
from strikeline.streaming.trades import trade_stream, trade_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

AS_OF = "2024-01-10"
UPDATED_AT = "2024-01-10 09:30:00"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__wrapped__ = fn
    REGISTRY[fn.__name__] = run
    return run


# --- shared inputs -------------------------------------------------------------


def _options(spark, d):
    return ins.of_type(dt.instrument_master(spark, d), fixed.OPTION_TYPE)


def _futures(spark, d):
    return ins.of_type(dt.instrument_master(spark, d), fixed.FUTURE_TYPE)


def _chain(spark, d):
    return ins.option_chain(_options(spark, d), AS_OF)


def _prices(spark, d):
    return bar_ops.last_price(bar_ops.minute_bars(dt.ticks(spark, d)))


def _config(spark, d):
    return ins.trading_config(
        _futures(spark, d), _options(spark, d), dt.calendar(spark, d), AS_OF,
        F.lit(UPDATED_AT).cast("timestamp_ntz"),
    )


def _signals(spark, d):
    return minute.signals(dt.snapshots(spark, d))


def _looked_up(spark, d):
    return dec.attach_daily_strikes(_signals(spark, d), _options(spark, d))


def _slices(spark, d):
    return slices_of(dt.quotes(spark, d), ["token"], "ts")


def _decided(spark, d):
    return dec.entry_decisions(_looked_up(spark, d), dt.quotes(spark, d), _slices(spark, d))


def _open(spark, d):
    return readers.open_trades(dt.live_trades(spark, d))


def _closing(spark, d):
    now = tr.current_signals(_signals(spark, d))
    return dec.price_at(
        tr.closable(_open(spark, d), now), dt.quotes(spark, d),
        "OPT_TOKEN", "exit_ts", "exit_price", _slices(spark, d),
    )


# --- indicator votes and signals -----------------------------------------------


@query
def votes_oscillators(spark, d):
    return ind.votes_of(dt.snapshots(spark, d), votes.OSCILLATORS, ("event_id",))


@query
def votes_moving_averages(spark, d):
    return ind.votes_of(dt.snapshots(spark, d), votes.MOVING_AVERAGES, ("event_id",))


@query
def votes_unwired(spark, d):
    return ind.votes_of(dt.snapshots(spark, d), votes.UNCOUNTED, ("event_id",))


@query
def votes_by_kind(spark, d):
    return ind.vote_totals(dt.snapshots(spark, d), ("symbol", "tf"))


@query
def recommend_levels(spark, d):
    return dt.snapshots(spark, d).select(
        "event_id", *[votes.recommend(s).alias(s) for s in votes.SCORES]
    )


@query
def vote_counts(spark, d):
    return ind.vote_counts(dt.snapshots(spark, d), ("event_id",))


@query
def signal_rollup(spark, d):
    return ind.rollup(dt.snapshots(spark, d), ("event_id", "symbol", "tf", "ts"))


@query
def scanner_payload(spark, d):
    return readers.snapshots_from_arrays(dt.scanner_arrays(spark, d))


@query
def scanner_by_name(spark, d):
    named = readers.scanner_map(dt.scanner_arrays(spark, d))
    at = lambda n: F.try_element_at("indicators", F.lit(n))
    return named.select(
        "event_id", at("RSI").alias("rsi"), at("AO[2]").alias("ao2"), at("close").alias("close"),
        at("volume").alias("volume"),
    )


@query
def feed_intervals(spark, d):
    codes = F.array(*[F.lit(i) for _, i, _, _ in fixed.TIMEFRAMES], F.lit("3m"))
    interval = F.element_at(codes, (F.col("event_id") % 11 + 1).cast("int"))
    return dt.read(spark, d, "events").select("event_id", interval.alias("interval")).withColumn(
        "suffix", readers.feed_suffix(F.col("interval"))
    )


@query
def prev_bar_lag(spark, d):
    snaps = dt.snapshots(spark, d).select(
        "symbol", "tf", "ts", "event_id", "rsi", "k", "d", "cci", "pdi", "ndi", "ao", "mom"
    )
    return ind.add_previous_bars(snaps, slices_of(snaps, ["symbol", "tf"], "ts"))


@query
def signals_dedup(spark, d):
    return ind.latest_per_minute(
        dt.snapshots(spark, d).select("symbol", "tf", "ts", "event_id", "score_all", "close")
    )


@query
def signal_log(spark, d):
    return ind.signal_log(_signals(spark, d))


@query
def session_signal_log(spark, d):
    """The signals of a fortnight's open days, from snapshots stored by day: other days and
    other hours are not read."""
    path, snapshots = shared_dir(spark), dt.snapshots(spark, d)
    write_sessions(snapshots, path)
    open_days = ins.open_days(dt.january_calendar(spark, d), "2024-01-08", "2024-01-21")
    days = [r.day for r in open_days.collect()]  # 14 at most
    return ind.signal_log(minute.signals(read_sessions(spark, path, snapshots.schema, days)))


@query
def cycle_number(spark, d):
    return _signals(spark, d).select("symbol", "tf", "minute", "session_date", "C_NUM")


@query
def timeframe_fan_out(spark, d):
    per_minute = dt.ticks(spark, d).groupBy(
        "symbol", clock.minute_of(F.col("ts")).alias("minute")
    ).agg(F.count("*").alias("ticks"))
    return ind.per_timeframe(per_minute).select(
        "symbol", "minute", "tf", "ticks",
        ids.cycle_id(F.col("symbol"), F.col("minute")).alias("SID"),
        ids.signal_id(F.col("symbol"), F.col("tf"), F.col("minute")).alias("UID"),
    )


# --- strikes ---------------------------------------------------------------------


def _line_prices(spark, d):
    """Line prices, every second one moved to an exact half."""
    half = F.floor("l_extendedprice") + 0.5
    return dt.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 2 == 0, half).otherwise(F.col("l_extendedprice"))
        .cast("double").alias("price"),
    )


@query
def atm_strikes_round(spark, d):
    call = strikes.call_strike(F.col("price"))
    low, high = strikes.band(call, fixed.CHECK_BAND)
    return _line_prices(spark, d).select(
        "*", call.alias("CSP"), strikes.put_strike(call).alias("PSP"),
        low.alias("low"), high.alias("high"),
    )


@query
def atm_strikes_trunc(spark, d):
    call = strikes.call_strike(F.col("price"), mode="trunc")
    put = strikes.put_strike(call)
    bands = [*strikes.band(call, fixed.BUILD_BAND), *strikes.band(put, fixed.BUILD_BAND)]
    names = ("ce_low", "ce_high", "pe_low", "pe_high")
    return _line_prices(spark, d).select(
        "*", call.alias("CSP"), put.alias("PSP"), *[b.alias(n) for b, n in zip(bands, names)]
    )


@query
def atm_strikes_text(spark, d):
    price = F.when(
        F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("string")
    ).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(
        F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5"))
    )
    call, put = strikes.strikes_from_text(F.col("price"))
    return dt.read(spark, d, "orders").select("o_orderkey", price.alias("price")).select(
        "*", call.alias("CSP"), put.alias("PSP")
    )


@query
def price_guard(spark, d):
    """Which of a line's prices, made NaN, null, zero or negative for some, can be traded on,
    and their strikes."""
    case = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    price = (
        F.when(case == 0, F.lit(float("nan"))).when(case == 1, F.lit(None)).when(case == 2, 0.0)
        .when(case == 3, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    ).cast("double")
    return dt.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", strikes.usable(price).alias("usable"),
        strikes.call_strike(price).alias("CSP"),
        strikes.call_strike(price, mode="trunc").alias("CSP_trunc"),
    )


# --- reference data ----------------------------------------------------------------


@query
def instrument_filter(spark, d):
    return _options(spark, d)


@query
def instrument_issues(spark, d):
    return ins.unreadable_expiries(_futures(spark, d)).unionByName(
        ins.unreadable_expiries(_options(spark, d))
    )


@query
def not_expired(spark, d):
    return ins.not_expired(_futures(spark, d), AS_OF).select("token", "symbol", "expiry_date")


@query
def distinct_expiries(spark, d):
    return ins.distinct_expiries(_options(spark, d))


@query
def current_future(spark, d):
    return ins.current_future(_futures(spark, d), AS_OF)


@query
def current_option_expiry(spark, d):
    return ins.current_option_expiry(_options(spark, d), AS_OF)


@query
def option_chain(spark, d):
    return _chain(spark, d)


@query
def chain_calls(spark, d):
    return ins.one_side(_chain(spark, d), fixed.CALL)


@query
def strike_band(spark, d):
    return ins.in_band(_chain(spark, d), _prices(spark, d))


@query
def strike_ladder(spark, d):
    return ins.ladder(_chain(spark, d))


@query
def trading_config(spark, d):
    return _config(spark, d)


@query
def trading_config_json(spark, d):
    """The config as a JSON document and read back from it."""
    config = _config(spark, d)
    fields = [c for c in config.columns if c != "name"]
    as_text = config.select(
        "name",
        F.to_json(F.struct(*fields), {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}).alias("doc"),
    )
    return readers.trading_config_from_text(as_text, "doc").drop("doc")


@query
def config_key_touched(spark, d):
    """The config of two keys, of which one is touched."""
    main = F.col("name").isin(dt.SYMBOLS[0], dt.SYMBOLS[-1])
    keyed = _config(spark, d).withColumn("ke", F.when(main, "MAIN").otherwise("SPARE"))
    return ins.touch_config(keyed, "MAIN", "2024-01-12").select("name", "T_DATE", "ke")


@query
def expiry_valid(spark, d):
    return ins.expiry_status(_config(spark, d), "2024-01-12").select(
        "name", "fut_valid", "opt_valid"
    )


@query
def market_open(spark, d):
    days = dt.read(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("day")
    ).distinct()
    return ins.day_status(days, dt.calendar(spark, d))


@query
def session_flags(spark, d):
    local = clock.local_time(F.col("ts"))
    return dt.read(spark, d, "events").select(
        "event_id", local.alias("local_ts"), clock.in_session(local).alias("in_session"),
        clock.stop_entry(local).alias("stop_entry"), clock.close_all(local).alias("close_all"),
    )


@query
def freshness(spark, d):
    return dt.read(spark, d, "events").select(
        "event_id", clock.is_fresh(F.col("ts"), F.lit(AS_OF).cast("date")).alias("fresh")
    )


@query
def timestamp_digest(spark, d):
    return dt.read(spark, d, "events").select(
        "event_id", ids.timestamp_digest(F.col("ts")).alias("digest")
    )


# --- prices -------------------------------------------------------------------------


@query
def tick_bars(spark, d):
    return bar_ops.all_timeframes(bar_ops.minute_bars(dt.ticks(spark, d)))


@query
def last_price(spark, d):
    return _prices(spark, d)


def _asking(spark, d):
    return dt.read(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") % 200).cast("string").alias("token"),
    )


@query
def asof_price(spark, d):
    """Last quote of an option at each event's time."""
    priced = asof_join(_asking(spark, d), dt.quotes(spark, d), ["token"], "ts", ["ltp"])
    return priced.withColumn("usable", dec.usable(F.col("ltp")))


@query
def stored_asof_price(spark, d):
    """The same from a quote store that was loaded in two parts, the second one twice, as after
    a load that died; no quote is shuffled by the lookup."""
    path, quotes = shared_dir(spark), dt.quotes(spark, d)
    early = "ts < timestamp_ntz'2024-01-12 12:34:00'"
    store = stored_quotes(quotes.where(early), path)
    late = quotes.where(f"not ({early})")
    store.append(late)
    store.append(late)
    priced = QuoteStore.open(spark, path).price_at(_asking(spark, d), "token", "ts", "ltp")
    return priced.withColumn("usable", dec.usable(F.col("ltp")))


# --- decisions and trades --------------------------------------------------------------


_LOOKUP = ("symbol", "tf", "minute", "CSP", "PSP", "ce_token", "ce_symbol", "pe_token",
           "pe_symbol", "strike_ok")


@query
def strike_lookup(spark, d):
    return _looked_up(spark, d).select(*_LOOKUP)


@query
def strike_lookup_issues(spark, d):
    return dec.strike_issues(_looked_up(spark, d))


@query
def trade_params(spark, d):
    return dec.with_trade_params(_looked_up(spark, d)).select(
        "symbol", "tf", "minute", "TA_SIGNAL", "trade_type", "side", "strike", "opt_token",
        "opt_symbol", "quantity", "lot",
    )


@query
def entry_decisions(spark, d):
    return _decided(spark, d).select(
        "symbol", "tf", "minute", "TA_SIGNAL", "opt_token", "en_price", "can_enter"
    )


@query
def stored_entry_decisions(spark, d):
    """Entry decisions priced from a quote store."""
    store = stored_quotes(dt.quotes(spark, d), shared_dir(spark))
    return dec.entry_decisions(_looked_up(spark, d), store, None).select(
        "symbol", "tf", "minute", "TA_SIGNAL", "opt_token", "en_price", "can_enter"
    )


@query
def entry_issues(spark, d):
    return dec.entry_issues(_decided(spark, d))


@query
def close_rules(spark, d):
    """The close rules applied to every pair of consecutive signals seen in the data; the
    later one as the trading loop sees it, with silent feeds and the end of the session."""
    rolled = ind.rollup(dt.snapshots(spark, d), ("event_id", "ts"))
    seen = rolled.select(F.col("event_id") + 1, F.col("TA_SIGNAL").alias("held")).toDF(
        "event_id", "held"
    )
    ended = clock.close_all(clock.local_time(F.col("ts")))
    now = rolled.select(
        "event_id",
        F.when(ended, fixed.CLOSE_ALL).when(F.col("no_response"), fixed.NO_RESPONSE)
        .otherwise(F.col("TA_SIGNAL")).alias("TA_SIGNAL"),
    )
    pairs = now.join(seen, "event_id").groupBy("TA_SIGNAL", "held").agg(F.count("*").alias("n"))
    rules = tr.close_rules(spark)
    return pairs.join(
        F.broadcast(rules),  # 24 fixed rows
        (rules.signal == pairs.TA_SIGNAL) & (rules.closes == pairs.held), "left",
    ).select("TA_SIGNAL", "held", "n", rules.signal.isNotNull().alias("closed"))


@query
def close_rule_join(spark, d):
    return tr.closable(_open(spark, d), tr.current_signals(_signals(spark, d))).select(
        "UID", "symbol", "TS_TF", "EN_T_SIGNAL", "exit_signal", "exit_fprice", "exit_cycle",
        "exit_ts",
    )


@query
def no_duplicate_entry(spark, d):
    return tr.not_yet_open(_signals(spark, d), _open(spark, d)).select(
        "symbol", "tf", "minute", "TA_SIGNAL"
    )


@query
def trade_lifecycle(spark, d):
    return minute.history(
        dt.snapshots(spark, d), _options(spark, d), dt.quotes(spark, d), _slices(spark, d)
    )


@query
def trade_lifecycle_priced_exits(spark, d):
    """Of the closed trades, entry day, expiry and prices: no entry after the expiry, no exit
    without a price above zero."""
    trades = trade_lifecycle.__wrapped__(spark, d).where("TRADE_STATUS = 'CLOSE'")
    expiries = _options(spark, d).select(F.col("token").alias("OPT_TOKEN"), "expiry_date")
    return trades.join(expiries, "OPT_TOKEN").select(
        "UID", "EN_T_SIGNAL", "T_DATE", F.col("expiry_date").alias("expiry"), "EX_OPT_PRICE",
        (F.col("T_DATE") <= F.col("expiry_date")).alias("before_expiry"),
        dec.usable(F.col("EX_OPT_PRICE")).alias("priced"),
    )


@query
def open_positions(spark, d):
    return _open(spark, d)


@query
def exit_overlay(spark, d):
    return tr.overlay_exits(dt.live_trades(spark, d), tr.exit_values(_closing(spark, d)))


@query
def trade_versions(spark, d):
    """The trade table before and after a cycle, read back: one commit overlays the exits on the
    stored trades, the next one adds the entries; each rewrites the parts it touches."""
    stored = dt.live_trades(spark, d)
    trades = VersionedTable(spark, shared_dir(spark), stored.schema, "UID", trade_part("month"))
    first = trades.commit(stored)
    cycle = minute.cycle(
        _open(spark, d), tr.current_signals(_signals(spark, d)), _options(spark, d),
        dt.quotes(spark, d), _slices(spark, d),
    )
    exits = cut_lineage(cycle.exits.join(stored.select("UID", "T_DATE"), "UID"))
    trades.commit(exits, merge=lambda old, new, key: tr.overlay_exits(old, new))
    trades.commit(cut_lineage(cycle.entries))
    trades.prune(keep=3)
    return trades.read(first.number).withColumn("version", F.lit("first")).unionByName(
        trades.read().withColumn("version", F.lit("newest"))
    )


@query
def exit_issues(spark, d):
    return tr.exit_issues(_closing(spark, d))


@query
def unexitable_trades(spark, d):
    """Open trades that the newest signals close but that lack what a closing needs."""
    return tr.unexitable(_open(spark, d), tr.current_signals(_signals(spark, d)))


@query
def minute_cycle(spark, d):
    """One cycle on the stored trades: what enters."""
    now = tr.current_signals(_signals(spark, d))
    return minute.cycle(
        _open(spark, d), now, _options(spark, d), dt.quotes(spark, d), _slices(spark, d)
    ).entries


@query
def minute_cycle_exits(spark, d):
    """One cycle on the stored trades: what exits."""
    now = tr.current_signals(_signals(spark, d))
    return minute.cycle(
        _open(spark, d), now, _options(spark, d), dt.quotes(spark, d), _slices(spark, d)
    ).exits


# --- checks, logs, stored tables ----------------------------------------------------------


@query
def ladder_coverage(spark, d):
    return quality.missing_strikes(_chain(spark, d), _prices(spark, d))


@query
def dq_checks(spark, d):
    return validation.checks(_config(spark, d), _chain(spark, d), _prices(spark, d), AS_OF)


@query
def dq_verdict(spark, d):
    return quality.verdict(
        validation.checks(
            _config(spark, d), _chain(spark, d), _prices(spark, d), AS_OF, skip_market=True
        )
    )


@query
def generation_checks(spark, d):
    data = daily.daily_data(
        dt.instrument_master(spark, d), dt.calendar(spark, d), _prices(spark, d), AS_OF,
        F.lit(UPDATED_AT),
    )
    return data.checks


@query
def partition_presence(spark, d):
    """Expiry × side combinations of the future expiries for which no option is listed."""
    expected = ins.distinct_expiries(_futures(spark, d)).select(
        "name", F.col("expiry_date").alias("expiry"),
        F.explode(F.array(F.lit(fixed.CALL), F.lit(fixed.PUT))).alias("ce_or_pe"),
    )
    return quality.missing_partitions(expected, _chain(spark, d), ("name", "expiry", "ce_or_pe"))


def _issue_log(spark, d):
    """Decisions of the whole history and exits of the newest cycle: what was accepted, what was
    not and why, in one tagged write; the log rows made of it are appended and read back."""
    path = shared_dir(spark)
    looked_up, decided = _looked_up(spark, d), _decided(spark, d)
    now, held = tr.current_signals(_signals(spark, d)), _open(spark, d)
    closing = _closing(spark, d)
    why = lambda rows, *more: rows.withColumn(
        "message", F.concat_ws(" ", "issue_type", *more)
    )
    rows = logs.outcomes(
        entered=decided.where("can_enter"),
        exited=closing.where(dec.usable(F.col("exit_price"))).select(
            "symbol", F.col("TS_TF").alias("tf"), F.col("exit_ts").alias("minute")
        ),
        strike=dec.strike_issues(looked_up).withColumn("message", F.col("issue_msg")),
        entry=why(dec.entry_issues(decided), "opt_token"),
        exit=why(tr.exit_issues(closing), "UID"),
        unexitable=why(tr.unexitable(held, now), "UID"),
    )
    kinds = ("entered", "exited", "strike", "entry", "exit", "unexitable")
    counts = logs.store_outcomes(rows, kinds, f"{path}/outcomes")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/outcomes")
    log = logs.run_log(stored, counts, kinds[:2], "minute job", "2024-01-31 00:00:00")
    logs.append_log(log, f"{path}/log")
    return spark.read.schema(log.schema).parquet(f"{path}/log").select(*log.columns)


@query
def issue_log(spark, d):
    return _issue_log(spark, d)


@query
def log_history(spark, d):
    return logs.to_history(_issue_log(spark, d), AS_OF, F.lit("2024-01-31 00:00:00"))


@query
def log_current(spark, d):
    return logs.still_current(_issue_log(spark, d), AS_OF)


@query
def chain_snapshot(spark, d):
    """The banded chain stored by expiry and side, one side read back."""
    path = shared_dir(spark)
    banded = ins.in_band(_chain(spark, d), _prices(spark, d))
    writers.write_chain(banded, path)
    return readers.option_chain(spark, path, side=fixed.PUT)


@query
def csv_copy(spark, d):
    path = shared_dir(spark)
    writers.write_csv(_config(spark, d).select("name", "FUT_TOKEN", "FUT_EXPIRY_DATE_STR"), path)
    return spark.read.csv(
        path, header=True, schema="name string, FUT_TOKEN string, FUT_EXPIRY_DATE_STR string"
    )


@query
def master_json(spark, d):
    """The instrument dump as JSON arrays, one of up to 1,000 records per file, and read back."""
    path = shared_dir(spark)
    master = dt.instrument_master(spark, d)
    thousand = F.floor(F.monotonically_increasing_id() / 1000)
    arrays = master.withColumn("file", thousand).groupBy("file").agg(
        F.to_json(F.collect_list(F.struct(*master.columns))).alias("value")
    )
    arrays.write.partitionBy("file").text(path)
    return readers.instrument_master(spark, path).select(*master.columns)


@query
def calendar_csv(spark, d):
    """The special-day list as CSV and read back."""
    path = shared_dir(spark)
    days = dt.calendar(spark, d).select(
        F.date_format("day", "dd-MM-yyyy").alias("date"), "market_open_status"
    )
    writers.write_csv(days, path)
    return readers.calendar(spark, path)


@query
def matching_columns(spark, d):
    """Some columns of the rows that equal given values."""
    held = readers.matching(dt.live_trades(spark, d), TRADE_STATUS="OPEN", TRADE_TYPE="SELL")
    return readers.columns(held, ["UID", "EN_T_SIGNAL", "T_CE_PE"])


@query
def appended_rows(spark, d):
    """Two appends to one table, the second with a computed column value of its own."""
    path = shared_dir(spark)
    days = dt.calendar(spark, d)
    for load in ("first", "second"):
        writers.append_rows(days, path, {"load": F.lit(load)})
    return spark.read.parquet(path)


@query
def wide_snapshots(spark, d):
    """A feed with a column per indicator and interval as rows per timeframe."""
    value = F.col("value")
    feed = {name: i for i, name in enumerate(readers.feed_columns("5m", ["RSI", "close"]))}
    wide = dt.read(spark, d, "events").select(
        F.lower("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        *[(value + i).alias(n) for n, i in feed.items()],
        *[(value * 2).alias(n) for n in readers.feed_columns("1h", ["close"])],
    )
    return readers.snapshots_from_wide(wide).select("symbol", "ts", "tf", "rsi", "close")


@query
def json_copy(spark, d):
    path = shared_dir(spark)
    config = _config(spark, d)
    writers.write_config(config.drop("name"), path)
    return readers.trading_config(spark, f"{path}/current")


def _staged(spark, d, root):
    """Banded chain and config, staged; the checks are those of the validation job."""
    covered, config = _prices(spark, d), _config(spark, d)
    generation = validation.stage(ins.in_band(_chain(spark, d), covered), config, root)
    return generation, lambda config, chain: validation.checks(
        config, chain, covered, AS_OF, skip_market=True
    )


@query
def promoted_chain(spark, d):
    """Banded chains of the underlyings that pass every check, published and read back. A second
    generation is staged but not published, so nobody reads it."""
    root = shared_dir(spark)
    generation, check = _staged(spark, d, root)
    validation.publish(spark, root, generation, check)
    validation.stage(_chain(spark, d).where("false"), _config(spark, d), root)
    return validation.published(spark, root).chain


@query
def promoted_config(spark, d):
    """The config that was published with the chain, and how many options belong to it."""
    root = shared_dir(spark)
    generation, check = _staged(spark, d, root)
    found = validation.publish(spark, root, generation, check)
    listed = found.chain.groupBy("name").agg(F.count("*").alias("options"))
    return found.config.join(listed, "name", "left").select(
        "name", "FUT_TOKEN", "OPT_EXPIRY_DATE_STR", "T_DATE", "options"
    )


@query
def required_inputs(spark, d):
    """Keys and stored partitions the trading job needs. One underlying's puts are not stored,
    and one config record has no expiry."""
    path = shared_dir(spark)
    put_of_last = (F.col("name") == dt.SYMBOLS[-1]) & (F.col("ce_or_pe") == fixed.PUT)
    writers.write_chain(
        ins.in_band(_chain(spark, d), _prices(spark, d)).where(~put_of_last), path,
        by=("name", "expiry", "ce_or_pe"),
    )
    config = _config(spark, d).withColumn(
        "OPT_EXPIRY_DATE_STR",
        F.when(F.col("name") != dt.SYMBOLS[1], F.col("OPT_EXPIRY_DATE_STR")),
    )
    return quality.required_inputs(config, readers.option_chain(spark, path))


@query
def config_by_expiry(spark, d):
    """The copies of the config filed by future expiry, read back with the folder's name."""
    path = shared_dir(spark)
    writers.write_config(_config(spark, d), path)
    filed = StructType([*schemas.NAMED_CONFIG.fields, StructField("filed_under", StringType())])
    stored = spark.read.schema(filed).options(timestampNTZFormat="yyyy-MM-dd HH:mm:ss").json(
        f"{path}/by_expiry"
    )
    return stored.select("filed_under", "name", "FUT_EXPIRY_DATE", "UPDATED_DATE_TIME")


# --- streams (one run over what is there) -----------------------------------------------------


def _stream_of(spark, d, name):
    schema = dt.read(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _events_stream(spark, d):
    return _stream_of(spark, d, "events")


@query
def stream_signals(spark, d):
    """Signals of all minutes the watermark has passed."""
    stream = signal_stream(dt.snapshots_of(_events_stream(spark, d)))
    path = shared_dir(spark)
    append_to(stream, f"{path}/table", f"{path}/progress").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


@query
def signal_log_replayed(spark, d):
    """The signal log of a stream that sends its newest half twice and whose batches are written
    again, as after a crash: every signal once."""
    path = shared_dir(spark)
    signals = cut_lineage(_signals(spark, d).drop("C_NUM"))
    half = signals.where("minute > timestamp_ntz'2024-01-15'")
    for part in (signals.where("minute <= timestamp_ntz'2024-01-15'"), half, half):
        part.coalesce(1).write.mode("append").parquet(f"{path}/arriving")
    stream = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/arriving"
    )
    log = f"{path}/log"
    log_signals(unique_signals(stream), log, f"{path}/progress").awaitTermination()
    log_batch(ind.signal_log(signals), 0, log)
    log_batch(ind.signal_log(half), 1, log)
    return logged_signals(spark, log)


@query
def stream_trades(spark, d):
    """Trades closed by the streamed signals."""
    path = shared_dir(spark)
    trade_stream(
        signal_stream(dt.snapshots_of(_events_stream(spark, d))),
        lambda: _options(spark, d), lambda: dt.quotes(spark, d), path, f"{path}/progress",
    ).awaitTermination()
    return trade_table(spark, path).read().where("TRADE_STATUS = 'CLOSE'")


@query
def stream_trade_events(spark, d):
    """Stored decisions streamed through keyed state, priced by the stream of quotes."""
    path = shared_dir(spark)
    decided = _decided(spark, d)
    decided.write.parquet(f"{path}/decisions")
    stream = spark.readStream.schema(decided.schema).parquet(f"{path}/decisions")
    quotes = dt.quotes_of(_stream_of(spark, d, "lineitem"))
    events = trade_events(stream, quotes, _options(spark, d))
    append_to(events, f"{path}/events", f"{path}/progress").awaitTermination()
    stored = spark.read.schema(EVENT_SCHEMA).parquet(f"{path}/events")
    return stored.withColumn("at", F.col("at").cast("timestamp_ntz"))
