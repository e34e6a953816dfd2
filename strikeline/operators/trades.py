"""Paper trades from decisions: entries, exits, open positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions.clock import local_time
from strikeline.operators.decisions import price_at, usable
from strikeline.operators.ordered import Slices, asof_join, previous_values, slices_of
from strikeline.session import cut_lineage

KEY = ("symbol", "tf", "trade_signal")
EXIT = ("exit_ts", "exit_signal", "exit_fprice", "exit_cycle")

# signal -> entry signals it closes (fixed values)
CLOSES = {
    fixed.STRONG_BUY: fixed.SELL_FAMILY,
    fixed.BUY: fixed.SELL_FAMILY,
    fixed.STRONG_SELL: fixed.BUY_FAMILY,
    fixed.SELL: fixed.BUY_FAMILY,
    fixed.NEUTRAL: fixed.TRADABLE,
    fixed.ERROR: fixed.TRADABLE,
    fixed.NO_RESPONSE: fixed.TRADABLE,
    fixed.CLOSE_ALL: fixed.TRADABLE,
}


def closers_of(entry_signal: str) -> list[str]:
    return [s for s, closed in CLOSES.items() if entry_signal in closed]


def close_rules(spark: SparkSession) -> DataFrame:
    """The close rules as a table (signal, closes): 24 pairs."""
    pairs = [(s, c) for s, closed in CLOSES.items() for c in closed]
    return spark.createDataFrame(pairs, "signal string, closes string")


def closes(signal: Column, entry_signal: Column) -> Column:
    """Whether ``signal`` closes a trade entered on ``entry_signal``."""
    rules = [
        (entry_signal == x) & signal.isin(*closers_of(x)) for x in fixed.TRADABLE
    ]
    return reduce(lambda a, b: a | b, rules)


# --- set-based lifecycle -----------------------------------------------------


def pair_trades(
    decisions: DataFrame, exit_requires_strike: bool = True, carried: DataFrame | None = None
) -> DataFrame:
    """Pair every entry with the signal that closes it.

    ``decisions`` has one row per symbol, timeframe and minute. For each tradable signal
    the rows either open it (``can_enter``) or close it; a trade runs from the first
    opening row after a closing one to the next closing row. Work is done per session
    day, a group of at most 1,440 minutes; per key only the first rows of a day and a
    trade left open at its end (three rows at most) are brought together across days.

    ``carried``: trades still open from before the first decision (key and ``entry``).

    Result: key, ``entry`` (the opening decision), ``exit_ts``, ``exit_signal``,
    ``exit_fprice``, ``exit_cycle`` (null while open).
    """
    gate = F.col("strike_ok") if exit_requires_strike else F.lit(True)
    day = Window.partitionBy("symbol", "session_date", "tf").orderBy("minute")
    before = day.rowsBetween(Window.unboundedPreceding, -1)

    opens = {
        x: F.when(F.col("can_enter") & (F.col("TA_SIGNAL") == x), True)
        .when(gate & F.col("TA_SIGNAL").isin(*closers_of(x)), False)
        for x in fixed.TRADABLE
    }
    acting = decisions.withColumns({f"_opens_{x}": c for x, c in opens.items()})
    seen = acting.withColumns(
        {f"_last_{x}": F.last(f"_opens_{x}", ignorenulls=True).over(before) for x in opens}
    )
    turns = [
        F.when(
            F.col(f"_opens_{x}").isNotNull()
            & ~F.col(f"_opens_{x}").eqNullSafe(F.col(f"_last_{x}")),
            F.struct(F.lit(x).alias("trade_signal"), F.col(f"_opens_{x}").alias("opens")),
        )
        for x in opens
    ]
    turning = seen.select(
        F.struct(*decisions.columns).alias("row"), "symbol", "session_date", "tf", "minute",
        F.explode(F.array_compact(F.array(*turns))).alias("turn"),
    ).select("symbol", "session_date", "tf", "minute", "row", "turn.*")

    in_day = Window.partitionBy("symbol", "session_date", "tf", "trade_signal").orderBy("minute")
    closing = F.struct(
        F.col("minute").alias("ts"), F.col("row.TA_SIGNAL").alias("signal"),
        F.col("row.FPRICE").alias("fprice"), F.col("row.C_NUM").alias("cycle"),
    )
    placed = turning.select(
        "*", F.row_number().over(in_day).alias("place"), F.lead(closing).over(in_day).alias("out"),
    )
    opened, place = F.col("opens"), F.col("place")
    at_edge = (place == 1) | ((place == 2) & ~opened) | (opened & F.col("out").isNull())

    # the few edge rows of all days meet in one group per key, other rows stay in their day
    together = placed.withColumn("within", F.when(~at_edge, F.col("session_date")))
    if carried is not None:
        together = together.unionByName(
            carried.select(
                *KEY, F.col("entry.minute").alias("minute"), F.col("entry").alias("row"),
                F.lit(True).alias("opens"),
            ),
            allowMissingColumns=True,
        )
    across = Window.partitionBy(*KEY, "within").orderBy("minute")
    at_edge = F.col("within").isNull()
    joined = (
        together.withColumn("held", F.lag("opens").over(across))
        .where(~at_edge | ~opened.eqNullSafe(F.col("held")))
        .withColumn("out", F.when(at_edge, F.lead(closing).over(across)).otherwise(F.col("out")))
    )
    return joined.where(opened).select(
        *KEY, F.col("row").alias("entry"),
        *[F.col(f"out.{c}").alias(f"exit_{c}") for c in ("ts", "signal", "fprice", "cycle")],
    )


def with_exit_price(pairs: DataFrame, quotes: DataFrame, slices: Slices) -> DataFrame:
    """Add ``exit_price``: the last price of the traded option when it is closed."""
    return price_at(
        pairs.withColumn("opt_token", F.col("entry.opt_token")),
        quotes, "opt_token", "exit_ts", "exit_price", slices,
    )


def _unless_open(value: Column, empty: Column) -> Column:
    return F.when(F.col("exit_ts").isNull(), empty).otherwise(value)


def trade_rows(priced: DataFrame) -> DataFrame:
    """The 23 stored trade columns plus the symbol."""
    e = lambda c: F.col(f"entry.{c}")
    entered = e("local_ts")
    return priced.select(
        "symbol", e("UID").alias("UID"), F.col("tf").alias("TS_TF"),
        e("trade_type").alias("TRADE_TYPE"), F.col("trade_signal").alias("EN_T_SIGNAL"),
        e("FPRICE").alias("EN_FUT_PRICE"), e("strike").alias("OPT_STRIKE_PRICE"),
        e("opt_symbol").alias("OPT_SYMBOL"), e("opt_token").alias("OPT_TOKEN"),
        e("en_price").alias("EN_OPT_PRICE"),
        _unless_open(F.lit("CLOSE"), F.lit("OPEN")).alias("TRADE_STATUS"),
        e("lot").alias("TRADE_LOT"),
        F.dayofmonth(entered).alias("T_DAY"), F.month(entered).alias("T_MONTH"),
        F.year(entered).alias("T_YEAR"), e("session_date").alias("T_DATE"),
        e("side").alias("T_CE_PE"),
        _unless_open(F.col("exit_price"), F.lit(0.0)).alias("EX_OPT_PRICE"),
        _unless_open(F.col("exit_signal"), F.lit("")).alias("EX_T_SIGNAL"),
        _unless_open(F.col("exit_fprice"), F.lit(0.0)).alias("EX_FUT_PRICE"),
        e("C_NUM").alias("EN_C_NUM"),
        _unless_open(F.col("exit_cycle"), F.lit(0)).alias("EX_C_NUM"),
        _unless_open(local_time(F.col("exit_ts")), entered).alias("UPDATED_DATETIME"),
        entered.alias("CREATE_DATETIME"),
    )


# --- exits that fail for want of a price --------------------------------------


def closing_rows(decisions: DataFrame, exit_requires_strike: bool = True) -> DataFrame:
    """Every (key, minute) at which a trade of that key would be closed."""
    gate = F.col("strike_ok") if exit_requires_strike else F.lit(True)
    closed = [F.when(F.col("TA_SIGNAL").isin(*closers_of(x)), x) for x in fixed.TRADABLE]
    return decisions.where(gate).select(
        "symbol", "tf", F.explode(F.array_compact(F.array(*closed))).alias("trade_signal"),
        F.col("minute").alias("exit_ts"), F.col("TA_SIGNAL").alias("exit_signal"),
        F.col("FPRICE").alias("exit_fprice"), F.col("C_NUM").alias("exit_cycle"),
    )


def settle_exits(
    pairs: DataFrame, decisions: DataFrame, quotes: DataFrame, slices: Slices,
    exit_requires_strike: bool = True,
) -> DataFrame:
    """Exits with usable prices only: a close without one leaves the trade open until the
    next closing signal that has one, and entries in between are not taken.

    ``decisions`` is read several times and should be stored. The number of passes is fixed: how
    often a token's price drops out and comes back does not matter, see ``usable_closings``.
    """
    columns = [c for c in pairs.columns if not c.startswith("exit_")]
    closings = closing_rows(decisions, exit_requires_strike)
    by_key = slices_of(closings, KEY, "exit_ts")
    priced = cut_lineage(
        with_exit_price(pairs, quotes, slices).withColumn("nominal_ts", F.col("exit_ts"))
    )
    settled = F.col("exit_ts").isNull() | usable(F.col("exit_price"))
    failed = priced.where(~settled).select(
        *columns, "opt_token", "nominal_ts", F.col("exit_ts").alias("ts")
    )
    exits = priced.where(settled)
    if not failed.isEmpty():
        asked = cut_lineage(failed.groupBy(*KEY, "opt_token").agg(F.min("ts").alias("since")))
        retries = cut_lineage(usable_closings(asked, closings, quotes, by_key, slices))
        moved = asof_join(
            failed, retries, [*KEY, "opt_token"], "ts", [*EXIT, "exit_price"], forward=True
        )
        exits = exits.unionByName(moved.drop("ts"))
    return _without_overtaken(exits, by_key)


def usable_closings(
    asked: DataFrame, closings: DataFrame, quotes: DataFrame, by_key: Slices, slices: Slices
) -> DataFrame:
    """For each key and token in ``asked`` (after ``since``) the closing rows to retry at, by the
    ``ts`` from which they count: the first row whose ``ts`` is not before a failed close is the
    key's next closing with a usable price.

    A token's price can only be used again from a quote on at which it turns usable. Each such
    quote points to the key's next closing; those where the price is (still or again) usable
    stay. Were there an earlier usable closing than the first of these, it would lie between a
    turning quote and the next drop-out, and that quote would point to it or to one before it.
    An option is quoted for some weeks, which bounds the turning quotes of a token.
    """
    tokens = asked.select(F.col("opt_token").alias("token")).distinct()
    offered = cut_lineage(quotes.join(tokens, "token", "left_semi").select("token", "ts", "ltp"))
    by_time = offered.where(F.col("ts").isNotNull()).groupBy("token", "ts").agg(
        usable(F.max("ltp")).alias("usable")
    )
    before = previous_values(by_time, ["token"], ["ts"], {"was_usable": ("usable", 1)}, slices)
    turning = before.where(F.col("usable") & ~F.coalesce("was_usable", F.lit(False))).select(
        F.col("token").alias("opt_token"), "ts"
    )
    following = asof_join(
        asked.join(turning, "opt_token").where(F.col("ts") > F.col("since")).drop("since"),
        closings.withColumn("ts", F.col("exit_ts")), KEY, "ts", EXIT, by_key, forward=True,
    ).where(F.col("exit_ts").isNotNull())
    return price_at(following, offered, "opt_token", "exit_ts", "exit_price", slices).where(
        usable(F.col("exit_price"))
    )


def _without_overtaken(exits: DataFrame, by_key: Slices) -> DataFrame:
    """Drop trades whose entry lies inside a kept, prolonged trade of the same key."""
    never = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    marked = cut_lineage(
        exits.select(
            "*", F.col("entry.minute").alias("ts"),
            F.coalesce("exit_ts", never).alias("until"),
        )
    )
    prolonged = (F.col("nominal_ts").isNotNull()) & ~F.col("nominal_ts").eqNullSafe(
        F.col("exit_ts")
    )
    undecided = marked.where(prolonged).select(*KEY, "ts", "until")
    kept = None
    earlier = (
        Window.partitionBy(*KEY).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    )
    while not undecided.isEmpty():
        # nothing before it reaches this far: certainly kept
        clear = F.coalesce(F.col("ts") >= F.col("reach"), F.lit(True))
        ranked = cut_lineage(
            undecided.withColumn("reach", F.max("until").over(earlier))
            .select(*KEY, "ts", "until", clear.alias("certain"))
        )
        certain = ranked.where("certain").select(*KEY, "ts", "until")
        kept = certain if kept is None else kept.unionByName(certain)
        undecided = cut_lineage(
            asof_join(
                ranked.where("not certain").select(*KEY, "ts", "until"),
                certain.select(*KEY, "ts", F.col("until").alias("taken_until")),
                KEY, "ts", ["taken_until"], by_key,
            ).where(F.col("ts") >= F.col("taken_until")).drop("taken_until")
        )
    if kept is None:
        return marked.drop("ts", "until", "nominal_ts")
    # a prolonged trade must not cover itself: it counts from just after its entry
    taken = kept.select(
        *KEY, (F.col("ts") + F.expr("interval 1 microsecond")).alias("ts"),
        F.col("until").alias("taken_until"),
    )
    return (
        asof_join(marked, taken, KEY, "ts", ["taken_until"], by_key)
        .where(F.coalesce(F.col("ts") >= F.col("taken_until"), F.lit(True)))
        .drop("ts", "until", "taken_until", "nominal_ts")
    )


# --- the trade table ---------------------------------------------------------


def current_signals(signals: DataFrame) -> DataFrame:
    """The newest signal of each symbol and timeframe."""
    rest = [c for c in signals.columns if c not in ("symbol", "tf")]
    newest = F.max_by(F.struct(*rest), "minute").alias("s")
    return signals.groupBy("symbol", "tf").agg(newest).select("symbol", "tf", "s.*")


def can_exit() -> Column:
    """A stored trade that has all it takes to be closed."""
    named = (F.col("OPT_SYMBOL") != "") & (F.col("OPT_TOKEN") != "")
    return F.coalesce(named, F.lit(False)) & usable(F.col("EN_OPT_PRICE"))


def closed_by_signal(open_trades: DataFrame, signals: DataFrame) -> DataFrame:
    """Open trades that the current signal of their symbol and timeframe closes.
    ``signals``: one row per symbol and timeframe."""
    now = signals.select(
        "symbol", F.col("tf").alias("TS_TF"), F.col("TA_SIGNAL").alias("exit_signal"),
        F.col("FPRICE").alias("exit_fprice"), F.col("C_NUM").alias("exit_cycle"),
        F.col("minute").alias("exit_ts"),
    )
    return open_trades.join(now, ["symbol", "TS_TF"]).where(
        closes(F.col("exit_signal"), F.col("EN_T_SIGNAL"))
    )


def closable(open_trades: DataFrame, signals: DataFrame) -> DataFrame:
    """Open trades that have all it takes to be closed and that the current signal closes."""
    return closed_by_signal(open_trades.where(can_exit()), signals)


def unexitable(open_trades: DataFrame, signals: DataFrame) -> DataFrame:
    """Open trades that should close but lack symbol, token or entry price: an issue each."""
    return closed_by_signal(open_trades.where(~can_exit()), signals).select(
        "symbol", F.col("TS_TF").alias("tf"), F.col("exit_ts").alias("minute"), "UID",
        F.lit("NOT_EXITABLE").alias("issue_type"),
    )


def not_yet_open(signals: DataFrame, open_trades: DataFrame) -> DataFrame:
    """Tradable signals without an open trade of the same symbol, timeframe and signal."""
    held = open_trades.select(
        "symbol", F.col("TS_TF").alias("tf"), F.col("EN_T_SIGNAL").alias("TA_SIGNAL")
    ).distinct()
    tradable = signals.where(F.col("TA_SIGNAL").isin(*fixed.TRADABLE))
    return tradable.join(held, ["symbol", "tf", "TA_SIGNAL"], "left_anti")


EXIT_COLUMNS = (
    "EX_C_NUM", "EX_T_SIGNAL", "EX_FUT_PRICE", "EX_OPT_PRICE", "TRADE_STATUS", "UPDATED_DATETIME",
)


def exit_values(priced: DataFrame) -> DataFrame:
    """Exit columns, by UID, of closable trades with an ``exit_price``."""
    return priced.where(usable(F.col("exit_price"))).select(
        "UID",
        F.col("exit_cycle").alias("EX_C_NUM"), F.col("exit_signal").alias("EX_T_SIGNAL"),
        F.col("exit_fprice").alias("EX_FUT_PRICE"), F.col("exit_price").alias("EX_OPT_PRICE"),
        F.lit("CLOSE").alias("TRADE_STATUS"),
        local_time(F.col("exit_ts")).alias("UPDATED_DATETIME"),
    )


def exit_issues(priced: DataFrame) -> DataFrame:
    """Closable trades that stay open because their price is missing or not positive."""
    price = F.col("exit_price")
    return priced.where(~usable(price)).select(
        "symbol", F.col("TS_TF").alias("tf"), F.col("exit_ts").alias("minute"), "UID",
        F.when(price.isNull(), "NO_EXIT_QUOTE").otherwise("EXIT_PRICE_NOT_POSITIVE")
        .alias("issue_type"),
    )


def overlay_exits(trades: DataFrame, exits: DataFrame) -> DataFrame:
    """Trades with exit columns replaced where ``exits`` has the UID (one row per UID)."""
    fresh = exits.select("UID", *[F.col(c).alias(f"_{c}") for c in EXIT_COLUMNS])
    return trades.join(fresh, "UID", "left").select(
        *[
            F.coalesce(f"_{c}", c).alias(c) if c in EXIT_COLUMNS else F.col(c)
            for c in trades.columns
        ]
    )
