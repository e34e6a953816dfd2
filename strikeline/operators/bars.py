"""Price bars from ticks, and the last price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions.ids import order_key


def minute_bars(ticks: DataFrame, tie: str = "event_id") -> DataFrame:
    """One-minute bars: symbol, bar_ts, open, high, low, close, volume, ticks."""
    order = order_key(F.col("ts"), F.col(tie))
    return ticks.groupBy("symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bar_ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("ticks"),
    )


def _frame_start(minutes: int) -> Column:
    """Start of the frame a bar lies in; ``minutes`` divides the hour."""
    hour = "cast(date_trunc('hour', bar_ts) as timestamp_ntz)"
    return F.expr(f"{hour} + make_dt_interval(0, 0, minute(bar_ts) div {minutes} * {minutes}, 0)")


def all_timeframes(bars: DataFrame) -> DataFrame:
    """Bars of the five traded timeframes from one-minute bars: ticks are read and
    shuffled once, what is spread over the timeframes are minute bars only. Minute starts
    are unique per symbol, so no further tie-break is needed."""
    starts = F.array(*[
        F.struct(F.lit(tf).alias("tf"), _frame_start(minutes).alias("start"))
        for tf, minutes in fixed.TIMEFRAME_MINUTES.items()
    ])
    return (
        bars.withColumn("frame", F.explode(starts)).select("*", "frame.*")
        .groupBy("symbol", "tf", F.col("start")).agg(
            F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"),
            F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks"),
        )
        .withColumnRenamed("start", "bar_ts")
    )


def last_price(bars: DataFrame) -> DataFrame:
    """Close of each symbol's newest bar."""
    return bars.groupBy(F.col("symbol").alias("name")).agg(
        F.max_by("close", "bar_ts").alias("price")
    )
