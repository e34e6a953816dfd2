"""Daily reference-data job: instruments → config, current chain, banded chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from strikeline import fixed
from strikeline.operators import instruments as ops
from strikeline.operators import quality
from strikeline.sources import writers


@dataclass(frozen=True)
class DailyData:
    config: DataFrame
    chain: DataFrame
    banded: DataFrame
    issues: DataFrame
    checks: DataFrame


def daily_data(
    master: DataFrame, calendar: DataFrame, prices: DataFrame, as_of: str, updated_at: Column,
    names: list[str] | None = None,
) -> DailyData:
    """``prices``: name, price (last price of the underlying's future)."""
    futures = ops.of_type(master, fixed.FUTURE_TYPE, names)
    options = ops.of_type(master, fixed.OPTION_TYPE, names)
    chain = ops.option_chain(options, as_of)
    banded = ops.in_band(chain, prices)
    config = ops.trading_config(futures, options, calendar, as_of, updated_at)
    return DailyData(
        config=config,
        chain=chain,
        banded=banded,
        issues=ops.unreadable_expiries(futures).unionByName(ops.unreadable_expiries(options)),
        checks=quality.non_empty_checks(banded, config).unionByName(
            quality.key_checks(config, ("FUT_TOKEN", "FUT_EXPIRY_DATE_STR"))
        ),
    )


def store(data: DailyData, root: str) -> None:
    writers.write_config(data.config, f"{root}/config")
    writers.write_chain(data.banded, f"{root}/chain")
    writers.write_table(data.issues, f"{root}/issues")
