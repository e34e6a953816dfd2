"""Readers for the engine's inputs. All schemas are given, nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline import fixed, schemas

_STAMPS = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def instrument_master(spark: SparkSession, path: str) -> DataFrame:
    """Instrument dump: one JSON array of records per file.

    A file is one array and so is read by one task; keep the dump in several files, or
    convert it once with ``write_table``, when it is large.
    """
    return spark.read.schema(schemas.INSTRUMENT_MASTER).option("multiLine", True).json(path)


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """Special-day list (CSV with header) with its ``day`` parsed from dd-MM-yyyy."""
    raw = spark.read.csv(path, header=True, schema=schemas.CALENDAR)
    day = F.try_to_timestamp("date", F.lit("dd-MM-yyyy")).cast("date")
    return raw.select(day.alias("day"), "market_open_status")


def trading_config(spark: SparkSession, path: str, names: bool = False) -> DataFrame:
    """Config records; ``names``: with the underlying each is for."""
    schema = schemas.NAMED_CONFIG if names else schemas.TRADING_CONFIG
    return spark.read.schema(schema).options(**_STAMPS).json(path)


def trading_config_from_text(df: DataFrame, column: str) -> DataFrame:
    """Config documents held as JSON text in a column, one struct's fields per row."""
    parsed = F.from_json(column, schemas.TRADING_CONFIG, _STAMPS)
    return df.select("*", parsed.alias("config")).select(*df.columns, "config.*")


def option_chain(
    spark: SparkSession, path: str, expiry: str | None = None, side: str | None = None
) -> DataFrame:
    """Chain snapshot; expiry and side prune partitions."""
    chain = spark.read.schema(schemas.OPTION_CHAIN).parquet(path)
    if expiry is not None:
        chain = chain.where(F.col("expiry") == F.lit(expiry).cast("date"))
    if side is not None:
        chain = chain.where(F.col("ce_or_pe") == side)
    return chain


def table(spark: SparkSession, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any stored table: parquet / orc / json / csv by path, or ``fmt="jdbc"`` with
    ``location`` as the table name and url, driver, partitionColumn, … as options."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").option("dbtable", location).options(**options).load()
    return spark.read.format(fmt).options(**options).load(location)


def matching(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal all the given values (typed, never pasted into SQL)."""
    conditions: list[Column] = [F.col(k) == F.lit(v) for k, v in values.items()]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def columns(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    return df.select(*names) if names else df.select("*")


def open_trades(trades: DataFrame) -> DataFrame:
    return matching(trades, TRADE_STATUS="OPEN")


# --- indicator snapshots -----------------------------------------------------


def snapshots_from_arrays(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Scanner payload ``d`` to one named column per indicator.

    ``extra`` names further payload values that follow the standard ones.
    """
    named = [F.get("d", F.lit(i)).alias(n) for n, i in fixed.SNAPSHOT_POSITIONS.items()]
    start = len(fixed.SCANNER_COLUMNS)
    added = [F.get("d", F.lit(start + i)).alias(n) for i, n in enumerate(extra)]
    kept = [c for c in df.columns if c != "d"]
    return df.select(*kept, *named, *added)


def scanner_map(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Scanner payload as a name → value map."""
    names = F.array(*[F.lit(n) for n in (*fixed.SCANNER_COLUMNS, *extra)])
    return df.withColumn("indicators", F.map_from_arrays(names, F.col("d")))


def snapshots_from_wide(df: DataFrame) -> DataFrame:
    """One row per symbol and time with columns such as ``RSI|5`` (no suffix = one day)
    to one row per timeframe. Columns the feed does not have become null."""
    have = set(df.columns)

    def cell(i: int, suffix: str) -> Column:
        name = fixed.SCANNER_COLUMNS[i] + suffix
        return F.col(f"`{name}`").cast("double") if name in have else F.lit(None).cast("double")

    per_tf = [
        F.struct(
            F.lit(tf).alias("tf"),
            *[cell(i, suffix).alias(n) for n, i in fixed.SNAPSHOT_POSITIONS.items()],
        )
        for tf, _, suffix, _ in fixed.TIMEFRAMES
        if f"close{suffix}" in have
    ]
    return df.select(
        F.upper("symbol").alias("symbol"), "ts", F.explode(F.array(*per_tf)).alias("s")
    ).select("symbol", "ts", "s.*")


def feed_columns(interval: str, names: Sequence[str] = fixed.SCANNER_COLUMNS) -> list[str]:
    """Feed column names for one interval; an unknown interval means one day."""
    suffix = {i: s for _, i, s, _ in fixed.TIMEFRAMES}.get(interval, "")
    return [n + suffix for n in names]


def feed_suffix(interval: Column) -> Column:
    """Feed suffix of an interval code column; unknown or missing means one day ("")."""
    pairs = [F.lit(v) for _, i, s, _ in fixed.TIMEFRAMES for v in (i, s)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), interval), F.lit(""))
