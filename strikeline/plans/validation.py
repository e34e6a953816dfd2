"""Validation job: stage config and chain, check what was stored, publish what passed.

The trading job reads a published generation: chain and config that were checked together. A
generation's tables are written below a folder of its own; only then is it named in
``published``, in one step. A job that dies before leaves the generation before in force.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strikeline.operators import quality
from strikeline.sources import files, readers, writers


def checks(
    config: DataFrame, chain: DataFrame, prices: DataFrame, as_of: str,
    skip_freshness: bool = False, skip_market: bool = False, names: DataFrame | None = None,
) -> DataFrame:
    """Checks of all underlyings in ``names`` (default: whatever config, chain or prices
    name); one without config, price or strikes fails instead of going unmentioned."""
    if names is None:
        names = config.select("name").unionAll(chain.select("name")).unionAll(prices.select("name"))
    names = names.select("name").distinct()
    return quality.all_checks(
        quality.present_checks(names, config),
        quality.config_checks(config, as_of, skip_freshness, skip_market),
        quality.ladder_checks(chain, names.join(prices.select("name", "price"), "name", "left")),
    )


@dataclass(frozen=True)
class Generation:
    name: str
    chain: DataFrame
    config: DataFrame
    checks: DataFrame


def stage(chain: DataFrame, config: DataFrame, root: str) -> str:
    """Store (banded) chain and config of all underlyings where no reader looks yet; the name
    of the new generation."""
    generation = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"
    _store(chain, config, f"{root}/generations/{generation}/staged")
    return generation


def publish(
    spark: SparkSession, root: str, generation: str,
    check: Callable[[DataFrame, DataFrame], DataFrame],
) -> Generation:
    """Check the staged tables as they were stored (``check`` gets config and chain) and publish
    the underlyings whose checks all passed, with the checks. The last step names the
    generation."""
    home = f"{root}/generations/{generation}"
    chain, config = _stored(spark, f"{home}/staged")
    check(config, chain).write.parquet(f"{home}/checks")
    results = spark.read.parquet(f"{home}/checks")
    _store(quality.passed_only(chain, results), quality.passed_only(config, results), f"{home}/passed")
    done = published_names(spark, root)
    following = int(done[-1].split("-", 1)[0]) + 1 if done else 1
    files.create_whole(spark, f"{root}/published/{following:08d}-{generation}", "")
    return published(spark, root)


def promote(chain: DataFrame, config: DataFrame, results: DataFrame, root: str) -> Generation:
    """Stage and publish with results that are at hand."""
    generation = stage(chain, config, root)
    return publish(chain.sparkSession, root, generation, lambda *_: results)


def published_names(spark: SparkSession, root: str) -> list[str]:
    """What was published, oldest first: a number and the generation."""
    return [n for n in files.names(spark, f"{root}/published") if n[0].isdigit()]


def published(spark: SparkSession, root: str) -> Generation:
    """The generation in force; chain and config always belong together."""
    done = published_names(spark, root)
    if not done:
        raise FileNotFoundError(f"nothing is published below {root}")
    generation = done[-1].split("-", 1)[1]
    home = f"{root}/generations/{generation}"
    chain, config = _stored(spark, f"{home}/passed")
    return Generation(generation, chain, config, spark.read.parquet(f"{home}/checks"))


def prune(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = 3600) -> None:
    """Remove all but the newest ``keep`` published generations, and those that were staged
    but never published once they are older than the grace time."""
    done = published_names(spark, root)
    kept = {n.split("-", 1)[1] for n in done[-keep:]}
    for name in done[:-keep]:
        files.remove(spark, f"{root}/published/{name}")
    now = int(time.time() * 1000)
    for generation in files.names(spark, f"{root}/generations"):
        path = f"{root}/generations/{generation}"
        old = {n.split("-", 1)[1] for n in done[:-keep]}
        if generation in old or (
            generation not in kept and files.age_ms(spark, path, now) >= 1000 * grace_seconds
        ):
            files.remove(spark, path)


def _store(chain: DataFrame, config: DataFrame, home: str) -> None:
    writers.write_chain(chain, f"{home}/chain", by=("name", "expiry", "ce_or_pe"))
    writers.write_json(config, f"{home}/config")


def _stored(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    return (
        readers.option_chain(spark, f"{home}/chain"),
        readers.trading_config(spark, f"{home}/config", names=True),
    )
