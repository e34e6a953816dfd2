"""Snapshots stored by day of the market, so that a session is read without the rest.

A folder per local day, in it files in order of the time of day. ``second_of_day`` is a plain
integer, for which files keep bounds that a scan skips by; they keep none for zone-free
timestamps. Both columns follow from the time, so what is read back has the given columns only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructType

from strikeline import fixed
from strikeline.functions import clock
from strikeline.sources.writers import write_table

DAY, SECOND = "local_day", "second_of_day"


def write_sessions(
    rows: DataFrame, path: str, ts: str = "ts", zone: str = fixed.MARKET_ZONE,
    mode: str = "append",
) -> None:
    """Store rows by local day of ``ts``. Ranges of (day, second) are tasks, so a day that holds
    most of the rows is written by many. Rows without a time are in no session and left out."""
    local = clock.local_time(F.col(ts), zone)
    placed = rows.where(F.col(ts).isNotNull()).select(
        "*", local.cast("date").alias(DAY),
        F.floor(clock.time_of_day(local) / 1_000_000).cast("int").alias(SECOND),
    )
    ranges = placed.repartitionByRange(DAY, SECOND).sortWithinPartitions(DAY, SECOND)
    write_table(ranges, path, [DAY], mode)


def read_sessions(
    spark: SparkSession, path: str, schema: StructType, days: Sequence[date] | None = None,
    opens: str = fixed.SESSION_OPEN, closes: str = fixed.SESSION_CLOSE,
) -> DataFrame:
    """Stored rows of the sessions of ``days`` (default: every stored day). Folders of other days
    are not opened, parts of files outside the hours are skipped.

    The last second is read whole: who needs the hours to the microsecond filters once more, as
    the trading loop does.
    """
    stored = StructType(list(schema.fields)).add(SECOND, IntegerType()).add(DAY, DateType())
    first, last = (clock.micros_of(at) // 1_000_000 for at in (opens, closes))
    rows = spark.read.schema(stored).parquet(path).where(F.col(SECOND).between(first, last))
    if days is not None:
        rows = rows.where(F.col(DAY).isin(*days)) if days else rows.where("false")
    return rows.select(*schema.names)
