"""Rounding and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_div(numerator: Column, denominator: Column) -> Column:
    """Integer quotient of two longs, ties to even: exact arithmetic, the same on every engine (M1).

    Null if the denominator is null or zero.  Both sides must not be negative.
    """
    safe = F.when(denominator != 0, denominator)
    whole, rest = F.call_function("div", numerator, safe), numerator % safe
    up = (2 * rest > safe) | ((2 * rest == safe) & (whole % 2 != 0))
    return whole + F.when(up, 1).otherwise(0)


def clamp(value: Column, low, high) -> Column:
    """M3."""
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
