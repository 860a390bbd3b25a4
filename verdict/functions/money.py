"""Exact decimals: rounding modes, checked scales, amounts written as phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,6)"
#: The largest amount is below this, with at most this many decimals.
LIMIT, SCALE = "1000000000000", 6


def rounded(amount: Column, mode: str, scale: int = 0, up: str = "away") -> Column:
    """half_up, half_even, up or down at a scale of 0 to 6. up: away from zero, or ceiling in the knowledge runtime."""
    unit = F.lit(10**scale).cast("decimal(7,0)")
    shifted = amount.cast("decimal(24,6)") * unit
    if mode == "half_up":
        return F.round(amount, scale).cast(AMOUNT)
    if mode == "half_even":
        return F.bround(amount, scale).cast(AMOUNT)
    if mode == "up":
        whole = F.ceil(shifted) if up == "ceiling" else F.when(shifted < 0, F.floor(shifted)).otherwise(F.ceil(shifted))
    elif mode == "down":
        whole = F.when(shifted < 0, F.ceil(shifted)).otherwise(F.floor(shifted))
    else:
        raise ValueError(f"unknown rounding {mode}")
    return (whole.cast("decimal(24,0)") / unit).cast(AMOUNT)


def fits(amount: Column, negative: bool) -> Column:
    """Whether an exact value keeps to the scale and the bounds of an amount. A cast alone would round in silence."""
    kept = (amount == F.round(amount, SCALE)) & (F.abs(amount) < F.lit(LIMIT).cast("decimal(13,0)"))
    return kept if negative else kept & (amount >= 0)


def wire_decimal(text: Column) -> Column:
    """A decimal sent as text: digits, at most six decimals, below the limit; null otherwise."""
    value = F.when(text.rlike(r"^\d{1,12}(\.\d{1,6})?$"), text.try_cast(AMOUNT))
    return F.when(value < F.lit(LIMIT).cast("decimal(13,0)"), value)


def phrase_amount(text: Column) -> Column:
    """The amount of a phrase: digits, or groups of three after commas, with an optional unit word of 10,000.

    Ranges, approximations and several numbers give null, as do amounts beyond 999,999,999,999.
    """
    number = r"(\d{1,3}(?:,\d{3})+|\d+)"
    whole = rf"^\s*{number}\s*(만)?\s*(?:원)?\s*$"
    digits = F.regexp_replace(F.regexp_extract(text, whole, 1), ",", "").try_cast("decimal(18,0)")
    value = digits * F.when(F.regexp_extract(text, whole, 2) == "만", F.lit(10000)).otherwise(F.lit(1))
    return F.when(text.rlike(whole) & (value <= F.lit(999999999999)), value.cast("decimal(18,0)"))
