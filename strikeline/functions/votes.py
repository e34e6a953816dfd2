"""BUY / SELL / NEUTRAL votes as column expressions.

Every rule is data: the columns it needs, the condition for BUY and the one for SELL.
A missing (null) input means the indicator casts no vote. A NaN makes each comparison
it takes part in false; Spark instead orders NaN above every number, so inside the
conditions (names in braces) NaN becomes null, where a null comparison never fires.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeline import fixed


@dataclass(frozen=True)
class VoteRule:
    name: str
    inputs: tuple[str, ...]
    buy: str | None
    sell: str | None

    def case(self, buy: str, sell: str, neutral: str) -> str:
        """A CASE expression giving one of three results, or null without a vote."""
        comparable = {c: f"nanvl({c}, null)" for c in self.inputs}
        missing = " OR ".join(f"{c} IS NULL" for c in self.inputs)
        branches = [f"WHEN {missing} THEN NULL"]
        for condition, outcome in ((self.buy, buy), (self.sell, sell)):
            if condition is not None:
                branches.append(f"WHEN {condition.format(**comparable)} THEN {outcome}")
        return f"CASE {' '.join(branches)} ELSE {neutral} END"


def _crossing(name: str, upper: str, lower: str) -> VoteRule:
    """BUY while ``upper`` is above ``lower``, SELL while it is below."""
    return VoteRule(
        name, (upper, lower), f"{{{upper}}} > {{{lower}}}", f"{{{upper}}} < {{{lower}}}"
    )


def _given(name: str, source: str) -> VoteRule:
    """The feed already decided: 1 is BUY, -1 is SELL."""
    return VoteRule(name, (source,), f"{source} = 1", f"{source} = -1")


OSCILLATORS: tuple[VoteRule, ...] = (
    VoteRule(
        "rsi_vote", ("rsi", "rsi1"),
        buy="{rsi} < 30 AND {rsi} > {rsi1}",
        sell="{rsi} > 70 AND {rsi} < {rsi1}",
    ),
    VoteRule(
        "stoch_vote", ("k", "d", "k1", "d1"),
        buy="{k} < 20 AND {d} < 20 AND {k} > {d} AND {k1} < {d1}",
        sell="{k} > 80 AND {d} > 80 AND {k} < {d} AND {k1} > {d1}",
    ),
    VoteRule(
        "cci_vote", ("cci", "cci1"),
        buy="{cci} < -100 AND {cci} > {cci1}",
        sell="{cci} > 100 AND {cci} < {cci1}",
    ),
    VoteRule(
        "adx_vote", ("adx", "pdi", "ndi", "pdi1", "ndi1"),
        buy="{adx} > 20 AND {pdi} > {ndi} AND {pdi1} < {ndi1}",
        sell="{adx} > 20 AND {pdi} < {ndi} AND {pdi1} > {ndi1}",
    ),
    VoteRule(
        "ao_vote", ("ao", "ao1", "ao2"),
        buy="{ao} > 0 AND ({ao1} < 0 OR ({ao1} > 0 AND {ao1} < {ao} AND {ao1} < {ao2}))",
        sell="{ao} < 0 AND ({ao1} > 0 OR ({ao1} < 0 AND {ao1} > {ao} AND {ao1} > {ao2}))",
    ),
    _crossing("mom_vote", "mom", "mom1"),
    _crossing("macd_vote", "macd", "macd_signal"),
    _given("stoch_rsi_vote", "rec_stoch_rsi"),
    _given("wr_vote", "rec_wr"),
    _given("bbp_vote", "rec_bbp"),
    _given("uo_vote", "rec_uo"),
)

AVERAGES = (
    "ema10", "sma10", "ema20", "sma20", "ema30", "sma30",
    "ema50", "sma50", "ema100", "sma100", "ema200", "sma200",
)
MOVING_AVERAGES: tuple[VoteRule, ...] = (
    *(_crossing(f"{name}_vote", "close", name) for name in AVERAGES),
    _given("ichimoku_vote", "rec_ichimoku"),
    _given("vwma_vote", "rec_vwma"),
    _given("hma9_vote", "rec_hma9"),
)

# Offered, but not part of any count.
UNCOUNTED: tuple[VoteRule, ...] = (
    VoteRule("bb_buy_vote", ("close", "bb_lower"), "{close} < {bb_lower}", None),
    VoteRule("bb_sell_vote", ("close", "bb_upper"), None, "{close} > {bb_upper}"),
    _crossing("psar_vote", "open", "psar"),
)

COUNTED = OSCILLATORS + MOVING_AVERAGES
SCORES = ("score_other", "score_all", "score_ma")


def vote(rule: VoteRule) -> Column:
    """The vote of one rule; null when an input is missing."""
    return F.expr(rule.case(*(f"'{x}'" for x in (fixed.BUY, fixed.SELL, fixed.NEUTRAL)))).alias(
        rule.name
    )


# Three counters side by side in one integer: a vote adds one to its own byte. One sum then
# counts all votes of a row without building the labels first.
_BYTE = 256
_SHIFT = {fixed.BUY: 0, fixed.SELL: 8, fixed.NEUTRAL: 16}


def ballot(rules: Sequence[VoteRule]) -> Column:
    """The votes of all rules of a row, counted (read it with ``tally``)."""
    places = [str(1 << shift) for shift in _SHIFT.values()]
    return F.expr(" + ".join(f"coalesce({r.case(*places)}, 0)" for r in rules))


def tally(counted: Column, label: str) -> Column:
    return F.shiftright(counted, _SHIFT[label]).bitwiseAND(_BYTE - 1)


def recommend(score: str) -> Column:
    """Five-level recommendation of a score in [-1, 1]; outside or NaN is ERROR."""
    s = F.col(score)
    out_of_range = F.isnan(s) | (s < -1) | (s > 1)
    return (
        F.when(s.isNull(), None)
        .when(out_of_range, fixed.ERROR)
        .when(s < -0.5, fixed.STRONG_SELL)
        .when(s < -0.1, fixed.SELL)
        .when(s <= 0.1, fixed.NEUTRAL)
        .when(s <= 0.5, fixed.BUY)
        .otherwise(fixed.STRONG_BUY)
    )


def no_response() -> Column:
    """True when a snapshot cannot be analysed at all."""
    return F.expr(" OR ".join(f"{c} IS NULL" for c in (*SCORES, "close")))
