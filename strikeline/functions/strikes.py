"""At-the-money strikes and strike bands around a price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeline import fixed


def usable(price: Column) -> Column:
    """Whether a price can be traded on: a number above zero. NaN, which sorts above all
    numbers, is none."""
    return F.coalesce((price > 0) & ~F.isnan(price), F.lit(False))


def _step_down(whole: Column) -> Column:
    """Largest-magnitude multiple of the strike step not beyond ``whole`` (toward zero)."""
    step = F.lit(fixed.STRIKE_STEP).cast("long")
    return whole - whole % step


def call_strike(price: Column, mode: str = "round") -> Column:
    """The call-side strike of a numeric price; null for NaN and infinity.

    ``round``: half-even to a whole number first (trading and checks).
    ``trunc``: drop the fraction first (building the strike band).
    """
    if mode == "round":
        whole = F.bround(price.cast("double"), 0).try_cast("bigint")
    elif mode == "trunc":
        whole = price.cast("double").try_cast("bigint")
    else:
        raise ValueError(f"mode must be 'round' or 'trunc', not {mode!r}")
    return _step_down(whole)


def put_strike(call: Column) -> Column:
    return call + fixed.STRIKE_STEP


def call_strike_from_text(price: Column) -> Column:
    """Call strike of a price held as text; null when the text is not a whole number."""
    return _step_down(price.try_cast("bigint"))


def strikes_from_text(price: Column) -> tuple[Column, Column]:
    """(call, put) strikes of a text price; (0, 0) when it is not a whole number."""
    call = call_strike_from_text(price)
    zero = F.lit(0).cast("long")
    return F.coalesce(call, zero), F.coalesce(put_strike(call), zero)


def strike_from_hundredths(text: Column) -> Column:
    """Strike text in hundredths ("4450000.000000") to a whole strike."""
    return (text.try_cast("double") / 100).try_cast("bigint")


def band(centre: Column, half_width: int) -> tuple[Column, Column]:
    return centre - half_width, centre + half_width
