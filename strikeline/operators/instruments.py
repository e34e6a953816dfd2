"""Reference data: current future, current option expiry, chain, strike bands, config."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions import clock, strikes


def as_date(as_of: str | Column) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("date")


def of_type(
    master: DataFrame, instrument_type: str, names: list[str] | None = None,
    segment: str = fixed.EXCHANGE_SEGMENT,
) -> DataFrame:
    """Instruments of one type in one segment (of some or all underlyings), with
    ``expiry_date`` parsed; an unreadable expiry stays as null, see ``unreadable_expiries``."""
    wanted = (F.col("exch_seg") == segment) & (F.col("instrumenttype") == instrument_type)
    if names is not None:
        wanted = wanted & F.col("name").isin(*names)
    return master.where(wanted).withColumn("expiry_date", clock.parse_expiry(F.col("expiry")))


def unreadable_expiries(instruments: DataFrame) -> DataFrame:
    return instruments.where(F.col("expiry_date").isNull()).select(
        "name", "token", "symbol", "instrumenttype",
        F.lit("UNREADABLE_EXPIRY").alias("issue_type"),
        F.concat_ws(" ", F.lit("expiry text:"), "expiry").alias("issue_msg"),
    )


def not_expired(instruments: DataFrame, as_of: str | Column) -> DataFrame:
    return instruments.where(F.col("expiry_date") >= as_date(as_of))


def current_future(futures: DataFrame, as_of: str | Column) -> DataFrame:
    """Per underlying: the nearest future not yet expired (smallest token on a tie)."""
    nearest = F.min(F.struct("expiry_date", "token", "symbol")).alias("f")
    return not_expired(futures, as_of).groupBy("name").agg(nearest).select(
        "name", F.col("f.expiry_date").alias("fut_expiry"),
        F.col("f.token").alias("fut_token"), F.col("f.symbol").alias("fut_symbol"),
    )


def distinct_expiries(options: DataFrame) -> DataFrame:
    return options.select("name", "expiry_date").distinct()


def current_option_expiry(options: DataFrame, as_of: str | Column) -> DataFrame:
    return not_expired(options, as_of).groupBy("name").agg(
        F.min("expiry_date").alias("opt_expiry")
    )


def option_chain(options: DataFrame, as_of: str | Column) -> DataFrame:
    """Call and put rows of every underlying's current expiry, strikes as whole numbers."""
    current = current_option_expiry(options, as_of).withColumnRenamed("opt_expiry", "expiry_date")
    return _chain_rows(options.join(current, ["name", "expiry_date"]))


def with_current_expiry(
    rows: DataFrame, options: DataFrame, name: str = "name", day: str = "session_date"
) -> DataFrame:
    """Add ``expiry``: the option expiry that is current on the row's own day, null after the
    last one. A name's expiries come as one sorted list, some hundred dates for ten years, so
    rows are neither multiplied nor read twice."""
    listed = options.where(F.col("expiry_date").isNotNull()).groupBy(F.col("name").alias(name)).agg(
        F.sort_array(F.collect_set("expiry_date")).alias("_expiries")
    )
    ahead = F.get(F.filter("_expiries", lambda e: e >= F.col(day)), F.lit(0))
    return rows.join(listed, name, "left").withColumn("expiry", ahead).drop("_expiries")


def chain_of_days(options: DataFrame, days: DataFrame) -> DataFrame:
    """The option chain of every (name, session_date) in ``days``: the rows of the expiry that
    is current on that day, with ``session_date``. A day after the last expiry has no rows."""
    current = with_current_expiry(days.select("name", "session_date").distinct(), options)
    return _chain_rows(
        options.join(current.withColumnRenamed("expiry", "expiry_date"), ["name", "expiry_date"]),
        "session_date",
    )


def chain_of_expiries(options: DataFrame) -> DataFrame:
    """Call and put rows of all expiries."""
    return _chain_rows(options.where(F.col("expiry_date").isNotNull()))


def _chain_rows(options: DataFrame, *more: str) -> DataFrame:
    return options.select(
        "name", "token", "symbol",
        strikes.strike_from_hundredths(F.col("strike")).alias("strike"),
        F.col("expiry_date").alias("expiry"),
        F.right("symbol", F.lit(2)).alias("ce_or_pe"), *more,
    ).where(F.col("ce_or_pe").isin(fixed.CALL, fixed.PUT))


def one_side(chain: DataFrame, side: str) -> DataFrame:
    return chain.where(F.col("ce_or_pe") == side).select("name", "token", "symbol", "strike")


def in_band(chain: DataFrame, prices: DataFrame, half_width: int = fixed.BUILD_BAND) -> DataFrame:
    """Chain rows near the last price: calls around the call strike, puts around the put
    strike (truncating variant). ``prices``: name, price; a price that is not above zero
    keeps nothing."""
    call = strikes.call_strike(F.col("price"), mode="trunc")
    centres = prices.where(strikes.usable(F.col("price"))).select("name", call.alias("call_centre"))
    centre = F.when(F.col("ce_or_pe") == fixed.CALL, F.col("call_centre")).otherwise(
        strikes.put_strike(F.col("call_centre"))
    )
    low, high = strikes.band(centre, half_width)
    return (
        chain.join(centres, "name").where(F.col("strike").between(low, high)).select(*chain.columns)
    )


def ladder(chain: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per underlying and call strike (and day, for a chain of days, or ``by`` other
    columns): the call at that strike and the put one step above it. The smallest token wins
    where a strike is listed twice."""
    days = [*by, *[c for c in ("session_date",) if c in chain.columns]]
    is_call = F.col("ce_or_pe") == fixed.CALL
    entry = F.struct("token", "symbol")
    call_at = F.when(is_call, F.col("strike")).otherwise(F.col("strike") - fixed.STRIKE_STEP)
    return (
        chain.groupBy(F.col("name").alias("symbol"), *days, call_at.alias("CSP"))
        .agg(
            F.min(F.when(is_call, entry)).alias("ce"),
            F.min(F.when(~is_call, entry)).alias("pe"),
        )
        .select(
            "symbol", *days, "CSP",
            F.col("ce.token").alias("ce_token"), F.col("ce.symbol").alias("ce_symbol"),
            F.col("pe.token").alias("pe_token"), F.col("pe.symbol").alias("pe_symbol"),
        )
    )


def day_status(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add ``market_is_open`` (YES/NO) to rows with a ``day``."""
    listed = calendar.groupBy("day").agg(F.min("market_open_status").alias("listed"))
    return days.join(listed, "day", "left").select(
        *days.columns, clock.market_open(F.col("day"), F.col("listed")).alias("market_is_open")
    )


def open_days(calendar: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """The ``day``s from the first to the last one on which the market opens."""
    first, last = (F.lit(d).cast("date") for d in (first_day, last_day))
    days = calendar.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return day_status(days, calendar).where("market_is_open = 'YES'").select("day")


def trading_config(
    futures: DataFrame, options: DataFrame, calendar: DataFrame, as_of: str,
    updated_at: Column, key: str = "MAIN",
) -> DataFrame:
    """One ten-field config record per underlying that has a current future and option
    expiry, plus its ``name``."""
    both = current_future(futures, as_of).join(current_option_expiry(options, as_of), "name")
    dated = day_status(both.withColumn("day", as_date(as_of)), calendar)
    return dated.select(
        "name",
        F.col("fut_expiry").alias("FUT_EXPIRY_DATE"),
        F.col("opt_expiry").alias("OPT_EXPIRY_DATE"),
        F.col("day").alias("T_DATE"),
        clock.format_expiry(F.col("fut_expiry")).alias("FUT_EXPIRY_DATE_STR"),
        clock.format_expiry(F.col("opt_expiry")).alias("OPT_EXPIRY_DATE_STR"),
        F.col("fut_token").alias("FUT_TOKEN"),
        F.col("fut_symbol").alias("FUT_SYMBOL"),
        F.col("market_is_open").alias("MARKET_IS_OPEN_TODAY"),
        updated_at.cast("timestamp_ntz").alias("UPDATED_DATE_TIME"),
        F.lit(key).alias("ke"),
    )


def expiry_status(config: DataFrame, as_of: str | Column) -> DataFrame:
    """Whether the configured expiries are still ahead."""
    day = as_date(as_of)
    return config.select(
        "*",
        clock.still_valid(F.col("FUT_EXPIRY_DATE"), day).alias("fut_valid"),
        clock.still_valid(F.col("OPT_EXPIRY_DATE"), day).alias("opt_valid"),
    )


def touch_config(config: DataFrame, key: str, as_of: str) -> DataFrame:
    """Set ``T_DATE`` of one config key to the as-of day."""
    return config.withColumn(
        "T_DATE", F.when(F.col("ke") == key, as_date(as_of)).otherwise(F.col("T_DATE"))
    )
