"""From indicator snapshots to one classified signal per symbol, timeframe and minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions import clock, ids, strikes, votes
from strikeline.operators.ordered import Slices, previous_values

PREVIOUS_BAR = {
    "rsi1": ("rsi", 1), "k1": ("k", 1), "d1": ("d", 1), "cci1": ("cci", 1),
    "pdi1": ("pdi", 1), "ndi1": ("ndi", 1), "ao1": ("ao", 1), "ao2": ("ao", 2),
    "mom1": ("mom", 1),
}


def add_previous_bars(snapshots: DataFrame, slices: Slices, tie: str = "event_id") -> DataFrame:
    """Fill in the previous-bar columns for a feed that does not send them."""
    base = snapshots.drop(*PREVIOUS_BAR)
    return previous_values(base, ["symbol", "tf"], ["ts", tie], PREVIOUS_BAR, slices)


def votes_of(snapshots: DataFrame, rules=votes.COUNTED, keep: tuple[str, ...] = ()) -> DataFrame:
    return snapshots.select(*keep, *[votes.vote(r) for r in rules])


def votes_long(snapshots: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per cast vote: ``kind`` (oscillator / moving_average), ``indicator``, ``vote``."""
    wide = votes_of(snapshots, votes.COUNTED, keep)
    cast = [
        F.struct(F.lit(kind).alias("kind"), F.lit(r.name).alias("indicator"),
                 F.col(r.name).alias("vote"))
        for kind, rules in (
            ("oscillator", votes.OSCILLATORS), ("moving_average", votes.MOVING_AVERAGES)
        )
        for r in rules
    ]
    return (
        wide.select(*keep, F.explode(F.array(*cast)).alias("v"))
        .select(*keep, "v.*").where(F.col("vote").isNotNull())
    )


def vote_counts(snapshots: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """BUY / SELL / NEUTRAL counts for oscillators, moving averages and both together."""
    kinds = {"osc": votes.OSCILLATORS, "ma": votes.MOVING_AVERAGES}
    cast = snapshots.select(*keep, *[votes.ballot(r).alias(f"_{k}") for k, r in kinds.items()])
    labels = (fixed.BUY, fixed.SELL, fixed.NEUTRAL)
    return cast.select(
        *keep,
        *[votes.tally(F.col(f"_{k}"), x).alias(f"{k}_{x.lower()}") for k in kinds for x in labels],
        *[votes.tally(F.col("_osc") + F.col("_ma"), x).alias(x) for x in labels],
    )


def vote_totals(snapshots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How often each kind of indicator cast each vote, per key: the rows of ``votes_long``
    counted, from the packed per-row counts instead of one row per vote."""
    kinds = {"oscillator": "osc", "moving_average": "ma"}
    labels = (fixed.BUY, fixed.SELL, fixed.NEUTRAL)
    columns = {(k, x): f"{short}_{x.lower()}" for k, short in kinds.items() for x in labels}
    sums = vote_counts(snapshots, keys).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in columns.values()]
    )
    rows = [
        F.struct(F.lit(k).alias("kind"), F.lit(x).alias("vote"), F.col(c).alias("n"))
        for (k, x), c in columns.items()
    ]
    return sums.select(*keys, F.explode(F.array(*rows)).alias("t")).select(
        *keys, "t.*"
    ).where("n > 0")


def rollup(snapshots: DataFrame, keep: tuple[str, ...] = ("symbol", "tf", "ts")) -> DataFrame:
    """Recommendation, counts and price per snapshot; a snapshot that cannot be analysed
    yields an empty signal with price 0 and no votes."""
    labels = {"TA_SIGNAL": "score_all", "OSCI": "score_other", "MA": "score_ma"}
    carried = snapshots.select(
        *keep, votes.no_response().alias("no_response"), F.col("close").alias("FPRICE"),
        *[votes.recommend(score).alias(label) for label, score in labels.items()],
        votes.ballot(votes.COUNTED).alias("ballot"),
    )
    silent = F.col("no_response")

    def unless_silent(value: Column, empty: Column) -> Column:
        return F.when(silent, empty).otherwise(value)

    return carried.select(
        *keep, "no_response",
        unless_silent(F.col("TA_SIGNAL"), F.lit("")).alias("TA_SIGNAL"),
        unless_silent(F.col("OSCI"), F.lit(None).cast("string")).alias("OSCI"),
        unless_silent(F.col("MA"), F.lit(None).cast("string")).alias("MA"),
        *[
            unless_silent(votes.tally(F.col("ballot"), x), F.lit(0)).alias(x)
            for x in (fixed.BUY, fixed.SELL, fixed.NEUTRAL)
        ],
        unless_silent(F.col("FPRICE"), F.lit(0.0)).alias("FPRICE"),
    )


def per_timeframe(rows: DataFrame, tfs: tuple[str, ...] = fixed.TRADED_TIMEFRAMES) -> DataFrame:
    """Fan one row per symbol and minute out to the traded timeframes."""
    return rows.withColumn("tf", F.explode(F.array(*[F.lit(t) for t in tfs])))


def latest_per_minute(snapshots: DataFrame, tie: str = "event_id") -> DataFrame:
    """The last snapshot of each symbol, timeframe and minute, as ``minute``.

    Partial aggregation keeps one row per group and map task, so a symbol with most of
    the rows does not travel whole.
    """
    keys = ("symbol", "tf")
    rest = [c for c in snapshots.columns if c not in (*keys, "ts", tie)]
    newest = F.max_by(F.struct("ts", tie, *rest), F.struct("ts", tie)).alias("s")
    return (
        snapshots.groupBy(*keys, clock.minute_of(F.col("ts")).alias("minute"))
        .agg(newest).select(*keys, "minute", "s.*")
    )


#: What a recommendation can be; a packed row holds its place.
_LABELS = (
    None, "", fixed.STRONG_SELL, fixed.SELL, fixed.NEUTRAL, fixed.BUY, fixed.STRONG_BUY,
    fixed.ERROR,
)
_LABELLED, _COUNTED = ("TA_SIGNAL", "OSCI", "MA"), (fixed.BUY, fixed.SELL, fixed.NEUTRAL)


def _packed() -> Column:
    """A row of ``rollup`` but its price as one number: three labels of three bits, three counts
    of up to 26 votes of five bits and whether there was a response."""
    place = F.create_map(*[F.lit(v) for i, x in enumerate(_LABELS) if x is not None for v in (x, i)])
    bits = F.col("no_response").cast("long")
    for i, c in enumerate(_LABELLED):
        code = F.coalesce(F.try_element_at(place, F.col(c)), F.lit(0)).cast("long")
        bits = bits + code * 2 ** (1 + 3 * i)
    for i, c in enumerate(_COUNTED):
        bits = bits + F.col(c).cast("long") * 2 ** (10 + 5 * i)
    return bits


def _unpacked(bits: Column) -> list[Column]:
    def part(shift: int, width: int) -> Column:
        return F.shiftright(bits, shift).bitwiseAND(2**width - 1).cast("int")

    names = F.array(*[F.lit(x).cast("string") for x in _LABELS])
    return [
        (part(0, 1) == 1).alias("no_response"),
        *[F.get(names, part(1 + 3 * i, 3)).alias(c) for i, c in enumerate(_LABELLED)],
        *[part(10 + 5 * i, 5).alias(c) for i, c in enumerate(_COUNTED)],
    ]


def latest_rollups(grouped, keys: tuple[str | Column, ...], tie: str = "event_id") -> DataFrame:
    """The newest rolled-up row of each group, as ``rollup`` gives it. ``grouped``: rows of
    ``rollup`` with ``ts`` and ``tie``, grouped; what aggregates and streams keep of a group is
    three fixed-width values."""
    order = ids.order_key(F.col("ts"), F.col(tie))
    return grouped.agg(
        F.max_by(_packed(), order).alias("_bits"), F.max_by("FPRICE", order).alias("FPRICE")
    ).select(*keys, *_unpacked(F.col("_bits")), "FPRICE")


def rollups_per_minute(snapshots: DataFrame, tie: str = "event_id") -> DataFrame:
    """``rollup`` of the last snapshot of each symbol, timeframe and minute."""
    rolled = rollup(snapshots, ("symbol", "tf", "ts", tie))
    grouped = rolled.groupBy("symbol", "tf", clock.minute_of(F.col("ts")).alias("minute"))
    return latest_rollups(grouped, ("symbol", "tf", "minute"), tie)


def in_session(rows: DataFrame, ts: str = "ts", **window: str) -> DataFrame:
    return rows.where(clock.in_session(clock.local_time(F.col(ts)), **window))


def minute_signals(rolled: DataFrame) -> DataFrame:
    """Signals of the trading loop, with their cycle number. ``rolled`` holds one row per
    symbol, timeframe and ``minute``."""
    return number_cycles(clocked_signals(rolled))


def clocked_signals(rolled: DataFrame) -> DataFrame:
    """Close-all override, strikes, ids and clock flags."""
    local = clock.local_time(F.col("minute"))
    return rolled.select(
        "symbol", "tf", "minute", local.alias("local_ts"),
        local.cast("date").alias("session_date"),
        "OSCI", "MA", "BUY", "SELL", "NEUTRAL", "FPRICE",
        F.when(clock.close_all(local), fixed.CLOSE_ALL)
        .otherwise(F.col("TA_SIGNAL")).alias("TA_SIGNAL"),
        strikes.call_strike(F.col("FPRICE")).alias("CSP"),
        clock.stop_entry(local).alias("stop_entry"),
        ids.cycle_id(F.col("symbol"), F.col("minute")).alias("SID"),
        ids.signal_id(F.col("symbol"), F.col("tf"), F.col("minute")).alias("UID"),
    ).withColumn("PSP", strikes.put_strike(F.col("CSP")))


def number_cycles(signals: DataFrame) -> DataFrame:
    """Count a symbol's minutes within a session, from 1.

    A group is one symbol's day: at most 1,440 minutes × timeframes.
    """
    day = Window.partitionBy("symbol", "session_date").orderBy("minute")
    return signals.withColumn("C_NUM", F.dense_rank().over(day))


def signal_log(signals: DataFrame) -> DataFrame:
    """The thirteen stored signal columns plus the symbol."""
    return signals.select(
        "symbol", "TA_SIGNAL", "MA", "OSCI", "FPRICE", "CSP", "PSP", "BUY", "NEUTRAL", "SELL",
        F.col("tf").alias("TF"), "SID", "UID", F.col("local_ts").alias("UPDATED_DATE_TIME"),
    )
