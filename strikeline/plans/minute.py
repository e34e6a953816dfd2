"""The trading loop: over a whole history at once, or one cycle on a trade table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.operators import decisions as dec
from strikeline.operators import indicators as ind
from strikeline.operators import trades as tr
from strikeline.operators.ordered import Slices
from strikeline.session import cut_lineage
from strikeline.sources.quotes import QuoteStore


def signals(snapshots: DataFrame, session_only: bool = True) -> DataFrame:
    """Indicator snapshots to one signal per symbol, timeframe and minute."""
    live = ind.in_session(snapshots) if session_only else snapshots
    return ind.minute_signals(ind.rollups_per_minute(live))


def history(
    snapshots: DataFrame, options: DataFrame, quotes: DataFrame, slices: Slices,
) -> DataFrame:
    """All trades of a history, set-based. Strikes come from the chain of each session day;
    a close without a usable price is retried at the next closing signal.
    """
    looked_up = dec.attach_daily_strikes(signals(snapshots), options)
    decided = dec.entry_decisions(looked_up, quotes, slices)
    decided = cut_lineage(decided)  # read again in every round of settling
    pairs = tr.pair_trades(decided)
    return tr.trade_rows(tr.settle_exits(pairs, decided, quotes, slices))


@dataclass(frozen=True)
class Cycle:
    exits: DataFrame
    entries: DataFrame
    issues: DataFrame


def cycle(
    open_trades: DataFrame, now: DataFrame, options: DataFrame,
    quotes: DataFrame | QuoteStore, slices: Slices | None,
) -> Cycle:
    """One minute: which open trades close, which signals enter.

    ``now`` has one signal per symbol and timeframe. Both decisions read the trades that
    were open when the minute began, so a signal may close one trade and open another.
    """
    looked_up = dec.attach_daily_strikes(now, options)
    listed = looked_up.where("strike_ok")
    closing = dec.price_at(
        tr.closable(open_trades, listed), quotes, "OPT_TOKEN", "exit_ts", "exit_price", slices
    )
    decided = dec.entry_decisions(looked_up, quotes, slices)
    entering = tr.not_yet_open(decided, open_trades)
    none = F.lit(None)
    entries = entering.where("can_enter").select(
        "symbol", "tf", F.col("TA_SIGNAL").alias("trade_signal"),
        F.struct(*decided.columns).alias("entry"),
        none.cast("timestamp_ntz").alias("exit_ts"), none.cast("string").alias("exit_signal"),
        none.cast("double").alias("exit_fprice"), none.cast("int").alias("exit_cycle"),
        none.cast("double").alias("exit_price"),
    )
    issues = [
        dec.strike_issues(looked_up).select("symbol", "tf", "minute", "issue_type"),
        dec.entry_issues(entering).select("symbol", "tf", "minute", "issue_type"),
        tr.exit_issues(closing).select("symbol", "tf", "minute", "issue_type"),
        tr.unexitable(open_trades, listed).select("symbol", "tf", "minute", "issue_type"),
    ]
    return Cycle(
        exits=tr.exit_values(closing),
        entries=tr.trade_rows(entries),
        issues=reduce(DataFrame.unionByName, issues),
    )
