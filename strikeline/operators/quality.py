"""Checks on the daily data, as rows: scope, check, passed, severity, message."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline import fixed
from strikeline.functions import clock, strikes
from strikeline.operators.instruments import as_date

CRITICAL, WARNING, INFO = "CRITICAL_ERROR", "WARNING", "ERROR_INFO"


def expected_ladder(prices: DataFrame, half_width: int = fixed.CHECK_BAND) -> DataFrame:
    """The strikes each underlying must list, per side: the call strike ± the band, for
    calls and puts alike. A price without a positive call strike expects none."""
    centre = strikes.call_strike(F.col("price"))
    low, high = strikes.band(F.col("centre"), half_width)
    ladder = F.sequence(low, high, F.lit(fixed.STRIKE_STEP).cast("long"))
    return (
        prices.where(strikes.usable(F.col("price"))).select("name", centre.alias("centre"))
        .where(F.col("centre") > 0)
        .select("name", F.explode(ladder).alias("strike"))
        .withColumn("ce_or_pe", F.explode(F.array(F.lit(fixed.CALL), F.lit(fixed.PUT))))
    )


def missing_strikes(chain: DataFrame, prices: DataFrame) -> DataFrame:
    listed = chain.select("name", "ce_or_pe", "strike").distinct()
    return expected_ladder(prices).join(listed, ["name", "ce_or_pe", "strike"], "left_anti")


def _check(scope: str, name: str, passed: Column, severity: str, message: Column) -> list[Column]:
    return [
        F.col(scope).cast("string").alias("scope"), F.lit(name).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.lit(severity).alias("severity"), message.alias("message"),
    ]


def config_checks(
    config: DataFrame, as_of: str, skip_freshness: bool = False, skip_market: bool = False
) -> DataFrame:
    """Required keys, freshness and market-open, one row per config record and check.
    A skipped check passes with a warning."""
    day = as_date(as_of)
    checks = []
    for key in ("UPDATED_DATE_TIME", "MARKET_IS_OPEN_TODAY", "OPT_EXPIRY_DATE_STR"):
        checks.append(_check(
            "name", f"has_{key}", F.col(key).isNotNull(), CRITICAL,
            F.when(F.col(key).isNull(), f"key {key} not found").otherwise(""),
        ))
    fresh = clock.is_fresh(F.col("UPDATED_DATE_TIME"), day)
    checks.append(
        _check("name", "fresh", F.lit(True), WARNING, F.lit("freshness check skipped"))
        if skip_freshness else
        _check("name", "fresh", fresh, CRITICAL,
               F.when(fresh, "").otherwise("not updated after the daily cut-off"))
    )
    is_open = F.coalesce(F.col("MARKET_IS_OPEN_TODAY") == "YES", F.lit(False))
    checks.append(
        _check("name", "market_open", F.lit(True), WARNING, F.lit("market-open check skipped"))
        if skip_market else
        _check("name", "market_open", is_open, INFO,
               F.when(is_open, "").otherwise("market is closed"))
    )
    rows = [
        F.struct(*check) for check in checks
    ]
    return config.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def present_checks(names: DataFrame, config: DataFrame) -> DataFrame:
    """One row for each underlying in ``names``: is there a config record for it."""
    there = config.select("name").distinct().withColumn("there", F.lit(True))
    found = F.col("there").isNotNull()
    return names.select("name").distinct().join(there, "name", "left").select(*_check(
        "name", "has_config", found, CRITICAL,
        F.when(found, "").otherwise("no config record"),
    ))


def ladder_checks(chain: DataFrame, prices: DataFrame) -> DataFrame:
    """Per underlying and side: is every expected strike listed. An underlying without a
    usable price has no expected strikes and fails."""
    expected = expected_ladder(prices)
    listed = chain.select("name", "ce_or_pe", "strike").distinct().withColumn("listed", F.lit(1))
    found = expected.join(listed, ["name", "ce_or_pe", "strike"], "left").groupBy(
        "name", "ce_or_pe"
    ).agg(F.count("*").alias("wanted"), F.count("listed").alias("found"))
    sides = prices.select("name").withColumn(
        "ce_or_pe", F.explode(F.array(F.lit(fixed.CALL), F.lit(fixed.PUT)))
    )
    complete = F.col("wanted") == F.col("found")
    text = F.when(F.col("wanted").isNull(), "no usable price").when(complete, "").otherwise(
        F.concat((F.col("wanted") - F.col("found")).cast("string"), F.lit(" strikes missing"))
    )
    joined = sides.join(found, ["name", "ce_or_pe"], "left")
    rows = joined.select("ce_or_pe", *_check("name", "strikes", complete, CRITICAL, text))
    return rows.withColumn("check", F.concat_ws("_", F.lower("ce_or_pe"), "check")).drop("ce_or_pe")


def non_empty_checks(chain: DataFrame, names: DataFrame) -> DataFrame:
    """Per underlying and side: did the daily job produce any rows."""
    counts = chain.groupBy("name", "ce_or_pe").agg(F.count("*").alias("n"))
    sides = names.select("name").withColumn(
        "ce_or_pe", F.explode(F.array(F.lit(fixed.CALL), F.lit(fixed.PUT)))
    )
    passed = F.coalesce(F.col("n") > 0, F.lit(False))
    rows = sides.join(counts, ["name", "ce_or_pe"], "left").select(
        "ce_or_pe",
        *_check("name", "generated", passed, CRITICAL, F.when(passed, "").otherwise("no rows")),
    )
    return rows.withColumn("check", F.concat_ws("_", F.lower("ce_or_pe"), "check")).drop("ce_or_pe")


def key_checks(config: DataFrame, keys: Sequence[str], severity: str = CRITICAL) -> DataFrame:
    """One row per config record and key: is it there and not empty."""
    rows = []
    for key in keys:
        there = F.coalesce(F.col(key).cast("string") != "", F.lit(False))
        rows.append(F.struct(*_check(
            "name", f"has_{key}", there, severity, F.when(there, "").otherwise(f"key {key} not found"),
        )))
    return config.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def required_inputs(config: DataFrame, stored: DataFrame) -> DataFrame:
    """What the trading job needs before it starts: for each config record its day and expiry,
    and options of both sides of that expiry in the stored chain. ``stored`` is a chain stored
    by name, expiry and side: counting by these reads the listing and the files' footers, no
    column."""
    present = stored.groupBy("name", "expiry", "ce_or_pe").count().where("count > 0").select(
        "name", F.col("expiry").cast("date").alias("expiry"), "ce_or_pe",
        F.lit(True).alias("there"),
    )
    wanted = config.select(
        "name", clock.parse_expiry(F.col("OPT_EXPIRY_DATE_STR")).alias("expiry"),
        F.explode(F.array(F.lit(fixed.CALL), F.lit(fixed.PUT))).alias("ce_or_pe"),
    )
    there = F.coalesce("there", F.lit(False))
    sides = wanted.join(present, ["name", "expiry", "ce_or_pe"], "left").select(
        "ce_or_pe",
        *_check("name", "stored", there, CRITICAL, F.when(there, "").otherwise("no stored options")),
    )
    sides = sides.withColumn("check", F.concat_ws("_", F.lower("ce_or_pe"), "check")).drop("ce_or_pe")
    return key_checks(config, ("T_DATE", "OPT_EXPIRY_DATE_STR")).unionByName(sides)


def missing_partitions(
    expected: DataFrame, chain: DataFrame, keys: Sequence[str] = ("expiry", "ce_or_pe")
) -> DataFrame:
    """Expected (expiry, side) combinations with no rows in the stored chain."""
    return expected.join(chain.select(*keys).distinct(), list(keys), "left_anti")


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def verdict(checks: DataFrame) -> DataFrame:
    """Per scope: whether every check passed, and how many failed."""
    return checks.groupBy("scope").agg(
        F.min("passed").alias("passed"),
        F.sum(F.when(F.col("passed"), 0).otherwise(1)).alias("failed_checks"),
    )


def passed_only(rows: DataFrame, checks: DataFrame, scope: str = "name") -> DataFrame:
    """Rows of those underlyings whose checks all passed."""
    good = verdict(checks).where("passed").select(F.col("scope").alias(scope))
    return rows.join(good, scope, "left_semi")
