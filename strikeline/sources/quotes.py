"""Quotes stored once, laid out so that a price lookup moves only those who ask.

A slot is a stretch of time. Quotes lie in a folder per day and in files by hash of
(token, slot), sorted by token and time, so rows of one token are spread over as many files as
it has slots, however many of all rows it holds. Next to them lies the last quote of every
token and slot, a table that is smaller by the number of quotes in a slot.

A lookup takes the last quote of an earlier slot from the small table and the last one of the
same slot from the files, which are read where they lie: only rows that ask are shuffled, and
days outside the asked range are not opened. Tokens that nobody asks for are left out of both
as they are read, unless very many are asked for. Appending the same quotes again changes no
answer, so a load that died is simply repeated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from strikeline.operators.ordered import Slices, asked_keys, asof_join, of_asked
from strikeline.session import cut_lineage
from strikeline.sources import files

_KEYLESS_PARTS = 4096
_DAY_MINUTES = 1440
#: Days of one load that a task writes side by side; rows of more days are sorted by day first.
_OPEN_DAYS = 64


class QuoteStore:
    """Stored quotes: token, ts, ltp.

    ``buckets`` is the number of files a day has, and of tasks a lookup has: as many as keep
    the quotes of the longest asked range, divided by them, fit for one task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, slot_minutes: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.slot_minutes = buckets, slot_minutes
        known = hashlib.md5(self.path.encode()).hexdigest()[:16]
        self._quotes, self._closes = f"quotes_{known}", f"quote_closes_{known}"
        # the catalog entry is only how files are found; it is made anew in every session
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._quotes} "
            "(token STRING, slot BIGINT, ts TIMESTAMP_NTZ, ltp DOUBLE, day DATE) USING parquet "
            "PARTITIONED BY (day) CLUSTERED BY (token, slot) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{self._place('quotes')}'"
        )
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._closes} "
            "(token STRING, ts TIMESTAMP_NTZ, ltp DOUBLE) USING parquet "
            f"LOCATION '{self._place('closes')}'"
        )

    def _place(self, name: str) -> str:
        return f"{self.path}/{name}".replace("'", "\\'")

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, buckets: int | None = None, slot_minutes: int = 60
    ) -> QuoteStore:
        """A new, empty store. ``buckets`` defaults to the number of shuffle partitions."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if buckets < 1 or slot_minutes < 1 or _DAY_MINUTES % slot_minutes:
            raise ValueError("at least one bucket, and slots that divide the day")
        layout = json.dumps({"buckets": buckets, "slot_minutes": slot_minutes})
        files.create_whole(spark, f"{path.rstrip('/')}/layout.json", layout)
        return cls(spark, path, buckets, slot_minutes)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> QuoteStore:
        """A store that exists, with the layout it was created with."""
        layout = json.loads(files.read_text(spark, f"{path.rstrip('/')}/layout.json"))
        store = cls(spark, path, layout["buckets"], layout["slot_minutes"])
        store._refresh()
        return store

    def _refresh(self) -> None:
        self.spark.sql(f"MSCK REPAIR TABLE {self._quotes}")
        self.spark.catalog.refreshTable(self._closes)

    def _slot(self, ts: Column) -> Column:
        of_day = F.floor((F.hour(ts) * 60 + F.minute(ts)) / self.slot_minutes)
        return F.unix_date(ts.cast("date")) * (_DAY_MINUTES // self.slot_minutes) + of_day

    def append(self, quotes: DataFrame) -> None:
        """Add quotes; those without token or time are left out. The one shuffle that
        quotes ever see. The small table comes second: until it is there a lookup may give
        an older quote, never a later one, and repeating the call mends it."""
        ts = F.col("ts").cast("timestamp_ntz")
        placed = quotes.where("token is not null and ts is not null").select(
            "token", self._slot(ts).cast("long").alias("slot"), ts.alias("ts"),
            F.col("ltp").cast("double").alias("ltp"), ts.cast("date").alias("day"),
        )
        # one order serves the files, whose days are then written side by side, and the groups
        by_bucket = placed.repartition(self.buckets, "token", "slot").sortWithinPartitions(
            "token", "slot", "ts", "ltp"
        ).persist(StorageLevel.DISK_ONLY)
        try:
            with _side_by_side(self.spark, _OPEN_DAYS):
                by_bucket.write.insertInto(self._quotes)
            newest = F.max(F.struct("ts", "ltp")).alias("quote")
            by_bucket.groupBy("token", "slot").agg(newest).select(
                "token", "quote.*"
            ).write.insertInto(self._closes)
        finally:
            by_bucket.unpersist()
        self._refresh()

    def read(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """token, ts, ltp of all days, or of those from ``first_day`` to ``last_day``."""
        return self._days(first_day, last_day).select("token", "ts", "ltp")

    def _days(self, first_day: str | None, last_day: str | None) -> DataFrame:
        quotes = self.spark.table(self._quotes)
        if first_day is not None:
            quotes = quotes.where(F.col("day") >= F.lit(first_day).cast("date"))
        if last_day is not None:
            quotes = quotes.where(F.col("day") <= F.lit(last_day).cast("date"))
        return quotes

    def price_at(
        self, rows: DataFrame, token: str, ts: str, name: str, slices: Slices | None = None,
        first_day: str | None = None, last_day: str | None = None,
    ) -> DataFrame:
        """Add as ``name`` the last stored price of ``token`` at or before ``ts``; of quotes
        with equal time the largest price counts; null without a quote, token or time.

        ``first_day`` and ``last_day`` say which days ``ts`` lies in, where that is known: quotes
        of other days are not read. A row outside them may then get an older price.
        """
        named = asked_keys(rows.select(F.col(token).alias("token")), ["token"])
        closes = of_asked(self.spark.table(self._closes), named, ["token"]).select(
            F.col("token").alias(token), F.col("ts").alias(ts), F.col("ltp").alias(name)
        )
        if named is not None:
            closes = cut_lineage(closes)  # what is left is read several times
        carried = asof_join(rows, closes, [token], ts, [name], slices)

        asked = [F.col(token).alias("token"), F.col(ts).cast("timestamp_ntz").alias("ts")]
        probes = carried.select(*asked, F.struct(*carried.columns).alias("probe")).withColumn(
            "slot", self._probe_slot()
        )
        # named anew: only then Spark sees that both sides of the union are placed alike
        stored = of_asked(self._days(first_day, last_day), named, ["token"]).select(
            *[F.col(c).alias(c) for c in ("token", "slot", "ts", "ltp")]
        )
        together = stored.unionByName(
            probes.repartition(self.buckets, "token", "slot"), allowMissingColumns=True
        )
        is_probe = F.col("probe").isNotNull()
        so_far = (
            Window.partitionBy("token", "slot").orderBy("ts", is_probe, "ltp")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        latest = F.last(F.when(~is_probe, F.struct("ltp")), ignorenulls=True).over(so_far)
        return (
            together.select("probe", latest.alias("quote")).where(is_probe)
            .select(
                *[F.col("probe").getField(c).alias(c) for c in rows.columns],
                F.when(F.col("quote").isNotNull(), F.col("quote.ltp"))
                .otherwise(F.col("probe").getField(name)).alias(name),
            )
        )

    def _probe_slot(self) -> Column:
        """Rows that lack token or time find nothing; they are spread by what they hold."""
        spread = F.pmod(F.xxhash64(F.col("probe").cast("string")), F.lit(_KEYLESS_PARTS))
        keyless = F.col("token").isNull() | F.col("ts").isNull()
        return F.when(keyless, -1 - spread).otherwise(self._slot(F.col("ts"))).cast("long")


@contextmanager
def _side_by_side(spark: SparkSession, folders: int) -> Iterator[None]:
    """Within it, a task keeps so many folders open instead of sorting its rows by folder."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(folders))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stored_quotes(
    quotes: DataFrame, path: str, buckets: int | None = None, slot_minutes: int = 60
) -> QuoteStore:
    """A new store at ``path`` that holds ``quotes``."""
    store = QuoteStore.create(quotes.sparkSession, path, buckets, slot_minutes)
    store.append(quotes)
    return store
