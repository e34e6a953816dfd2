"""Market inputs derived from the general test tables (events, part, orders, …).

Pure column expressions over whole tables; every row of the source is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline import fixed

# value range of each generated indicator column (fixed values)
RANGES: dict[str, tuple[float, float]] = {
    **{n: (-1.05, 1.05) for n in ("score_other", "score_all", "score_ma")},
    **{n: (0.0, 100.0) for n in ("rsi", "rsi1", "k", "d", "k1", "d1")},
    **{n: (-300.0, 300.0) for n in ("cci", "cci1")},
    **{n: (0.0, 60.0) for n in ("adx", "pdi", "ndi", "pdi1", "ndi1")},
    **{n: (-10.0, 10.0) for n in ("ao", "ao1", "ao2", "mom", "mom1", "macd", "macd_signal")},
    **{n: (44000.0, 45000.0) for n in (
        "ema10", "sma10", "ema20", "sma20", "ema30", "sma30", "ema50", "sma50",
        "ema100", "sma100", "ema200", "sma200", "open", "psar",
    )},
    "bb_lower": (43500.0, 44500.0),
    "bb_upper": (44200.0, 45500.0),
}
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _indicator(name: str) -> Column:
    i = fixed.SNAPSHOT_POSITIONS[name]
    spread = f"(event_id * {37 + 10 * i} + {i * 101}) % 2003"
    if name == "close":
        value = "44000D + value * 10D"
    elif name.startswith("rec_"):
        value = f"cast({spread} % 3 - 1 as double)"
    else:
        lo, hi = RANGES[name]
        value = f"{lo}D + cast({spread} as double) * {hi - lo}D / 2002D"
    return F.expr(f"CASE WHEN event_id % 17 <> {i % 17} THEN {value} END").alias(name)


def snapshots_of(events: DataFrame) -> DataFrame:
    """Indicator snapshots: symbol, tf, ts, event_id and one column per indicator."""
    return events.select(
        F.col("event_type").alias("symbol"),
        _pick(fixed.TRADED_TIMEFRAMES, F.col("user_id") % 5).alias("tf"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
        *[_indicator(n) for n in fixed.SNAPSHOT_POSITIONS],
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_of(read(spark, sf_dir, "events"))


def scanner_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshots as positional payloads of 91 values."""
    by_position = {i: n for n, i in fixed.SNAPSHOT_POSITIONS.items()}
    payload = [
        F.col(by_position[i]) if i in by_position else F.lit(None).cast("double")
        for i in range(len(fixed.SCANNER_COLUMNS))
    ]
    return snapshots(spark, sf_dir).select(
        "symbol", "tf", "ts", "event_id", F.array(*payload).alias("d")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id", (F.lit(44000.0) + F.col("value") * 10).alias("price"),
        F.lit(1).cast("long").alias("volume"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(read(spark, sf_dir, "lineitem"))


def quotes_of(lines: DataFrame) -> DataFrame:
    """Option quotes from order lines: spread over January 2024, some of them zero."""
    minutes = "cast((l_orderkey * 37 + l_linenumber * 1009) % 43200 as int)"
    return lines.select(
        F.col("l_partkey").cast("string").alias("token"),
        F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {minutes}, 0)")
        .alias("ts"),
        F.expr("CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN 0D ELSE l_extendedprice END")
        .alias("ltp"),
    )


def instrument_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw instrument records, all text: futures (every 41st part) and options, blocks of
    400 parts per underlying, four expiries of which the last is after all events, 50 strikes.

    Some records are futures, unreadable or of another segment, which leaves gaps in the
    ladders; the first underlying has none near its prices, and the last one always has one.
    """
    p = F.col("p_partkey")
    name = _pick(SYMBOLS, F.expr("p_partkey div 400") % 5)
    weeks = F.element_at(
        F.array(*[F.lit(w) for w in (4, 1, 0, 2)]),
        (F.expr("p_partkey div 100") % 4 + 1).cast("int"),
    )
    expiry = F.date_add(F.lit("2024-01-04").cast("date"), weeks * 7)
    strike = 43200 + 100 * (F.expr("p_partkey div 2") % 50)
    complete = (name == SYMBOLS[0]) & strike.between(43500, 45500)
    is_future = (p % 41 == 0) & ~complete
    side = F.when(p % 2 == 0, fixed.CALL).otherwise(fixed.PUT)
    gap = (name == SYMBOLS[-1]) & (strike == 44500) & (side == fixed.PUT) & ~is_future
    expiry_text = F.upper(F.date_format(expiry, "ddMMMyyyy"))
    option_symbol = F.concat(name, expiry_text, strike.cast("string"), side)
    return read(spark, sf_dir, "part").select(
        p.cast("string").alias("token"),
        F.when(is_future, F.concat(name, expiry_text, F.lit("FUT")))
        .otherwise(option_symbol).alias("symbol"),
        name.alias("name"),
        F.when((p % 97 == 96) & ~complete, "").otherwise(expiry_text).alias("expiry"),
        F.when(is_future, "-1.000000")
        .otherwise(F.concat((strike * 100).cast("string"), F.lit(".000000"))).alias("strike"),
        F.when(is_future, fixed.FUTURE_TYPE).otherwise(fixed.OPTION_TYPE).alias("instrumenttype"),
        F.when(((p % 53 == 52) & ~complete) | gap, "NSE").otherwise(fixed.EXCHANGE_SEGMENT)
        .alias("exch_seg"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with orders are listed; a day is a holiday when its first order key divides by 7."""
    return (
        read(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.min("o_orderkey").alias("first_key"))
        .select(
            "day",
            F.when(F.col("first_key") % 7 == 0, "NO").otherwise("YES").alias("market_open_status"),
        )
    )


def january_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A special-day list of the events' month: order keys choose a day, which is a holiday
    when the number of its orders divides by 3."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 31).cast("int"))
    return read(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(
        F.when(F.count("*") % 3 == 0, "NO").otherwise("YES").alias("market_open_status")
    )


def live_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade table from orders: status O is open, anything else closed. Of the last two
    underlyings one is only bought and one only sold."""
    o = F.col
    is_open = o("o_orderstatus") == "O"
    of_two = o("o_custkey") % 2
    signal = _pick(
        fixed.TRADABLE,
        F.when(o("o_custkey") % 5 == 3, of_two).when(o("o_custkey") % 5 == 4, 2 + of_two)
        .otherwise(o("o_custkey") % 4),
    )
    is_buy = signal.isin(*fixed.BUY_FAMILY)
    day = o("o_orderdate").cast("date")
    closed = lambda value, empty: F.when(is_open, empty).otherwise(value)
    return read(spark, sf_dir, "orders").select(
        o("o_orderkey").cast("string").alias("UID"),
        _pick(SYMBOLS, o("o_custkey") % 5).alias("symbol"),
        _pick(
            fixed.TRADED_TIMEFRAMES, F.substring("o_orderpriority", 1, 1).cast("int") - 1
        ).alias("TS_TF"),
        F.when(is_buy, fixed.BUY).otherwise(fixed.SELL).alias("TRADE_TYPE"),
        signal.alias("EN_T_SIGNAL"),
        (F.lit(44000.0) + o("o_orderkey") % 4900).alias("EN_FUT_PRICE"),
        (o("o_orderkey") % 49 * 100 + 44000).alias("OPT_STRIKE_PRICE"),
        F.concat(F.lit("OPT"), (o("o_orderkey") % 400).cast("string")).alias("OPT_SYMBOL"),
        (o("o_orderkey") % 400).cast("string").alias("OPT_TOKEN"),
        F.when(o("o_orderkey") % 31 == 0, 0.0).otherwise(o("o_totalprice")).alias("EN_OPT_PRICE"),
        F.when(is_open, "OPEN").otherwise("CLOSE").alias("TRADE_STATUS"),
        F.lit(1).alias("TRADE_LOT"),
        F.dayofmonth(day).alias("T_DAY"), F.month(day).alias("T_MONTH"),
        F.year(day).alias("T_YEAR"), day.alias("T_DATE"),
        F.when(is_buy, fixed.CALL).otherwise(fixed.PUT).alias("T_CE_PE"),
        closed(o("o_totalprice") / 2, F.lit(0.0)).alias("EX_OPT_PRICE"),
        closed(F.lit(fixed.NEUTRAL), F.lit("")).alias("EX_T_SIGNAL"),
        closed(F.lit(44500.0), F.lit(0.0)).alias("EX_FUT_PRICE"),
        F.lit(1).alias("EN_C_NUM"), closed(F.lit(2), F.lit(0)).alias("EX_C_NUM"),
        o("o_orderdate").cast("timestamp_ntz").alias("UPDATED_DATETIME"),
        o("o_orderdate").cast("timestamp_ntz").alias("CREATE_DATETIME"),
    )
