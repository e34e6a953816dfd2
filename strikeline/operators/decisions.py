"""Strike lookup, trade parameters, prices and the issues found on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions.strikes import usable
from strikeline.operators.instruments import chain_of_expiries, ladder, with_current_expiry
from strikeline.operators.ordered import Slices, asked_keys, asof_join, of_asked
from strikeline.session import cut_lineage
from strikeline.sources.quotes import QuoteStore

_LOTS = {tf: m for tf, _, _, m in fixed.TIMEFRAMES if m is not None}


def attach_strikes(signals: DataFrame, chain: DataFrame) -> DataFrame:
    """Add the call at CSP and the put at PSP; ``strike_ok`` needs both.

    The ladder is left to the optimizer: it is broadcast when its size is known to be
    small and joined by shuffle, with skewed keys split, when it is not. A chain with
    ``session_date`` is looked up by the signal's day.
    """
    days = [c for c in ("session_date",) if c in chain.columns]
    return signals.join(ladder(chain), ["symbol", *days, "CSP"], "left").withColumn(
        "strike_ok", F.col("ce_token").isNotNull() & F.col("pe_token").isNotNull()
    )


def attach_daily_strikes(signals: DataFrame, options: DataFrame) -> DataFrame:
    """Strikes from the chain that is current on each signal's own day. Signals are used once:
    each finds its expiry, and then its strikes in the ladder of that expiry."""
    steps = ladder(chain_of_expiries(options), by=["expiry"])
    dated = with_current_expiry(signals, options, name="symbol")
    return dated.join(steps, ["symbol", "expiry", "CSP"], "left").drop("expiry").withColumn(
        "strike_ok", F.col("ce_token").isNotNull() & F.col("pe_token").isNotNull()
    )


def strike_issues(looked_up: DataFrame) -> DataFrame:
    """One row per signal whose strikes are not listed; a missing call is reported first."""
    call_missing = F.col("ce_token").isNull()
    return looked_up.where(~F.col("strike_ok")).select(
        "symbol", "tf", "minute", "CSP", "PSP",
        F.when(call_missing, "MISSING_CE").otherwise("MISSING_PE").alias("issue_type"),
        F.when(call_missing, F.concat_ws(" ", F.lit("no call at strike"), "CSP"))
        .otherwise(F.concat_ws(" ", F.lit("no put at strike"), "PSP")).alias("issue_msg"),
    )


def lot_multiplier(tf: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in _LOTS.items() for v in pair])
    return F.try_element_at(table, tf)


def with_trade_params(looked_up: DataFrame) -> DataFrame:
    """What an entry on this signal would be; all null unless the signal is tradable."""
    signal = F.col("TA_SIGNAL")
    buys, sells = signal.isin(*fixed.BUY_FAMILY), signal.isin(*fixed.SELL_FAMILY)
    quantity = F.when(signal.isin(fixed.BUY, fixed.SELL), 1).when(buys | sells, 2)

    def by_side(call: str, put: str) -> Column:
        return F.when(buys, F.col(call)).when(sells, F.col(put))

    return looked_up.select(
        "*",
        F.when(buys, fixed.BUY).when(sells, fixed.SELL).alias("trade_type"),
        F.when(buys, fixed.CALL).when(sells, fixed.PUT).alias("side"),
        by_side("CSP", "PSP").alias("strike"),
        by_side("ce_token", "pe_token").alias("opt_token"),
        by_side("ce_symbol", "pe_symbol").alias("opt_symbol"),
        quantity.alias("quantity"),
        (lot_multiplier(F.col("tf")) * quantity).alias("lot"),
    )


def price_at(rows: DataFrame, quotes: DataFrame | QuoteStore, token: str, ts: str, name: str,
             slices: Slices | None) -> DataFrame:
    """Add the last traded price of ``token`` at ``ts``. ``quotes``: token, ts, ltp, or a
    store of them, which is read without moving them. Quotes of tokens that no row names are
    not moved, unless the rows name very many."""
    if isinstance(quotes, QuoteStore):
        return quotes.price_at(rows, token, ts, name, slices)
    offered = quotes.select(
        F.col("token").alias(token), F.col("ts").alias(ts), F.col("ltp").alias(name)
    )
    rows = cut_lineage(rows)  # they are read twice
    offered = of_asked(offered, asked_keys(rows, [token]), [token])
    return asof_join(rows, offered, [token], ts, [name], slices)


def entry_decisions(
    looked_up: DataFrame, quotes: DataFrame | QuoteStore, slices: Slices | None
) -> DataFrame:
    """Signals with entry price and ``can_enter``."""
    priced = price_at(
        with_trade_params(looked_up), quotes, "opt_token", "minute", "en_price", slices
    )
    tradable = F.col("trade_type").isNotNull()
    return priced.withColumn(
        "can_enter",
        tradable & F.col("strike_ok") & usable(F.col("en_price")) & ~F.col("stop_entry"),
    )


def entry_issues(decisions: DataFrame) -> DataFrame:
    """Tradable signals with strikes that cannot enter, and why. The price is asked for
    before the clock, so a bad price is the reported reason when both apply."""
    price = F.col("en_price")
    kind = (
        F.when(price.isNull(), "NO_QUOTE")
        .when(~usable(price), "PRICE_NOT_POSITIVE")
        .otherwise("ENTRY_STOPPED")
    )
    return decisions.where(
        F.col("strike_ok") & F.col("trade_type").isNotNull() & ~F.col("can_enter")
    ).select("symbol", "tf", "minute", "TA_SIGNAL", "opt_token", kind.alias("issue_type"))
