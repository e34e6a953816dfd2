"""Row ids that a retried task computes again unchanged."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def cycle_id(symbol: Column, minute: Column) -> Column:
    return F.sha2(F.concat_ws("|", symbol, _stamp(minute)), 256)


def signal_id(symbol: Column, tf: Column, minute: Column) -> Column:
    return F.sha2(F.concat_ws("|", symbol, tf, _stamp(minute)), 256)


def timestamp_digest(ts: Column) -> Column:
    return F.md5(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def order_key(ts: Column, tie: Column) -> Column:
    """One number that sorts like (ts, tie), for a whole-number ``tie``; a null tie comes first.
    Unlike a struct it can be updated in place, so aggregates ordered by it are hash-based."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)")
    number = tie.cast("decimal(20,0)") + F.lit(Decimal(2**63))
    return micros * F.lit(Decimal(2**65)) + F.coalesce(number, F.lit(Decimal(-1)))
