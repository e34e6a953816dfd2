"""Signals from a stream of indicator snapshots."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline import schemas
from strikeline.operators import indicators as ind
from strikeline.sources import files


def rollups_per_minute(
    snapshots: DataFrame, lateness: str = "1 minute", tie: str = "event_id"
) -> DataFrame:
    """Votes and recommendation of the last snapshot per symbol, timeframe and minute, emitted
    once the watermark has passed the minute. State holds three numbers a group."""
    timed = snapshots.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark(
        "event_time", lateness
    )
    rolled = ind.rollup(timed, ("symbol", "tf", "ts", tie, "event_time"))
    grouped = rolled.groupBy("symbol", "tf", F.window("event_time", "1 minute"))
    minute = F.col("window.start").cast("timestamp_ntz").alias("minute")
    return ind.latest_rollups(grouped, ("symbol", "tf", minute), tie)


def signal_stream(
    snapshots: DataFrame, lateness: str = "1 minute", session_only: bool = True
) -> DataFrame:
    live = ind.in_session(snapshots) if session_only else snapshots
    return ind.clocked_signals(rollups_per_minute(live, lateness))


def unique_signals(signals: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A stream of per-minute signals with repeats of a (symbol, tf, minute) removed."""
    return (
        signals.withColumn("event_time", F.col("minute").cast("timestamp"))
        .withWatermark("event_time", lateness)
        .dropDuplicatesWithinWatermark(["symbol", "tf", "minute"])
        .drop("event_time")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to a Parquet table; one run over what is there by default."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


# --- the stored log of signals ---------------------------------------------------


def log_batch(rows: DataFrame, batch_id: int, root: str) -> None:
    """Write a batch of the log, once: its folder is named after it, and it counts only when
    the commit log names it, which is the last step. A batch that was committed changes nothing;
    one that died is written anew over what it left."""
    spark, done = rows.sparkSession, f"{root}/commits/{batch_id:012d}"
    if files.exists(spark, done):
        return
    rows.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")
    files.create_whole(spark, done, "")


def log_signals(signals: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """Keep the signal log below ``root`` up to date with a stream of (unique) signals."""
    def write(batch: DataFrame, batch_id: int, root: str) -> None:
        log_batch(ind.signal_log(batch), batch_id, root)

    return (
        signals.writeStream.foreachBatch(partial(write, root=root))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def logged_signals(spark: SparkSession, root: str) -> DataFrame:
    """The log as far as it is committed. Batches are committed in order, so the newest commit
    bounds the folders that are read."""
    committed = files.names(spark, f"{root}/commits")
    last = int(committed[-1]) if committed else -1
    stored = spark.read.schema(schemas.SIGNAL_LOG).parquet(f"{root}/rows")
    return stored.where(F.col("batch_id") <= last).drop("batch_id")
