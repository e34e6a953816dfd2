"""Log rows from issues and checks, and the move of old log rows to history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strikeline.functions.clock import local_time
from strikeline.operators.instruments import as_date


def log_rows(
    issues: DataFrame, module: str, kind: Column, message: Column, logged_at: Column,
    environment: str = "SERVER",
) -> DataFrame:
    """One log row per issue."""
    at = logged_at.cast("timestamp_ntz")
    return issues.select(
        F.lit(module).alias("LOG_MODULE_NAME"), kind.alias("LOG_TYPE"),
        message.alias("LOG_MESSAGE"), F.lit(environment).alias("ENV_TYPE"),
        at.cast("date").alias("LOG_CREATE_DATE"), at.alias("LOG_CREATE_DATETIME"),
    )


def outcomes(**kinds: DataFrame) -> DataFrame:
    """What became of the rows of a run, as one table: ``outcome`` (the keyword), symbol, tf,
    minute and message. Accepted rows have no message."""
    def tagged(kind: str, rows: DataFrame) -> DataFrame:
        message = F.col("message") if "message" in rows.columns else F.lit(None).cast("string")
        return rows.select(
            F.lit(kind).alias("outcome"), "symbol", "tf", "minute", message.alias("message")
        )

    return reduce(DataFrame.unionByName, [tagged(k, rows) for k, rows in kinds.items()])


def store_outcomes(rows: DataFrame, kinds: Sequence[str], path: str) -> dict[str, int]:
    """Write the outcomes by kind, accepted and rejected ones in one job, and return how many of
    each kind that job has seen; nothing is read again to count them."""
    seen = Observation()
    counted = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    rows.observe(seen, *counted).write.partitionBy("outcome").parquet(path)
    return {k: seen.get[k] for k in kinds}


def run_log(
    stored: DataFrame, counts: Mapping[str, int], accepted: Sequence[str], module: str,
    finished_at: str,
) -> DataFrame:
    """Log rows of a run, ``LOG_KIND`` says of which log: ``error`` has a row for each rejected
    outcome, ``app`` a row that says how many there were of each kind."""
    issues = stored.where(~F.col("outcome").isin(*accepted))
    text = F.concat_ws(" ", "outcome", F.lit("issue:"), "message")
    errors = log_rows(issues, module, F.lit("ERROR"), text, local_time(F.col("minute")))
    summary = ", ".join(f"{n} {k}" for k, n in counts.items())
    success = stored.sparkSession.range(1)
    done = log_rows(success, module, F.lit("SUCCESS"), F.lit(summary), F.lit(finished_at))
    return errors.withColumn("LOG_KIND", F.lit("error")).unionByName(
        done.withColumn("LOG_KIND", F.lit("app"))
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append to the log, by kind (if there are several) and day."""
    by = [c for c in ("LOG_KIND", "LOG_CREATE_DATE") if c in rows.columns]
    rows.write.mode("append").partitionBy(*by).parquet(path)


def to_history(log: DataFrame, as_of: str, loaded_at: Column) -> DataFrame:
    """Log rows older than the as-of day, stamped with the load time."""
    return log.where(F.col("LOG_CREATE_DATE") < as_date(as_of)).withColumn(
        "LOAD_CREATE_DATETIME", loaded_at.cast("timestamp_ntz")
    )


def still_current(log: DataFrame, as_of: str) -> DataFrame:
    return log.where(F.col("LOG_CREATE_DATE") >= as_date(as_of))
