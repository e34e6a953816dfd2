"""Event-time clock rules. Timestamps hold UTC wall-clock time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeline import fixed


def local_time(ts: Column, zone: str = fixed.MARKET_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def time_of_day(local: Column) -> Column:
    """Microseconds since midnight, so 15:25:00.5 is after 15:25:00."""
    whole = (F.hour(local) * 3600 + F.minute(local) * 60).cast("long") * 1_000_000
    return whole + (F.date_part(F.lit("SECOND"), local) * 1_000_000).cast("long")


def micros_of(hms: str) -> int:
    hours, minutes, seconds = map(int, hms.split(":"))
    return ((hours * 60 + minutes) * 60 + seconds) * 1_000_000


def in_session(
    local: Column, opens: str = fixed.SESSION_OPEN, closes: str = fixed.SESSION_CLOSE
) -> Column:
    return time_of_day(local).between(micros_of(opens), micros_of(closes))


def stop_entry(local: Column) -> Column:
    return time_of_day(local) >= micros_of(fixed.STOP_ENTRY_AT)


def close_all(local: Column) -> Column:
    return time_of_day(local) >= micros_of(fixed.CLOSE_ALL_AT)


def is_fresh(updated: Column, as_of: Column) -> Column:
    """Updated on the as-of day and strictly after the daily cut-off."""
    late_enough = time_of_day(updated) > micros_of(fixed.CONFIG_FRESH_AFTER)
    return F.coalesce((updated.cast("date") == as_of) & late_enough, F.lit(False))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def market_open(day: Column, calendar_status: Column) -> Column:
    """YES/NO; a weekend is closed whatever the calendar says, an unlisted day is open."""
    return F.when(is_weekend(day), "NO").otherwise(F.coalesce(calendar_status, F.lit("YES")))


def parse_expiry(text: Column) -> Column:
    """"28DEC2023" to a date, null when it does not parse."""
    return F.try_to_timestamp(text, F.lit("ddMMMyyyy")).cast("date")


def format_expiry(day: Column) -> Column:
    return F.upper(F.date_format(day, "ddMMMyyyy"))


def still_valid(expiry: Column, as_of: Column) -> Column:
    return as_of <= expiry


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")
