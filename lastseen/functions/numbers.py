"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to_tenth(value: Column) -> Column:
    """Round a double to one decimal, half to even, judged on its binary value.

    ``bround`` rounds the shortest decimal text of the double, so 12.35, which
    is stored as 12.3499999999999996, becomes 12.4.  Here the double itself is
    compared with the halfway point: ``20 * value`` is split into a rounded sum
    and its exact error, so the comparison is free of rounding.
    """
    value = value.cast("double")
    tenths = F.floor(value * 10)
    high, low = value * 16, value * 4
    total = high + low
    carried = total - high
    error = (high - (total - carried)) + (low - carried)
    beyond_half = (total - (tenths * 2 + 1)) + error
    rounded = (
        F.when(beyond_half > 0, tenths + 1)
        .when(beyond_half < 0, tenths)
        .otherwise(tenths + F.pmod(tenths, F.lit(2)))
    ) / F.lit(10.0)
    # Twenty times the value has to fit the 53 bits of a double.  Beyond that a
    # double has so few decimals that its shortest text shows every halfway point.
    return F.when(F.abs(value) < 4e14, rounded).otherwise(F.bround(value, 1))


def percent(numerator: Column, denominator: Column) -> Column:
    """``100.0 * numerator / denominator``, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double") * 100.0, denominator.cast("double"))


def relative_change(current: Column, prior: Column) -> Column:
    """Change against ``prior`` in percent, to one decimal; null when it is 0."""
    return round_to_tenth(F.try_divide((current - prior).cast("double"), prior.cast("double")) * 100)


def occupied_share(available: Column, total: Column) -> Column:
    """Share of seats taken, ``1 - available/total``; null when total is 0."""
    return F.lit(1.0) - F.try_divide(available.cast("double"), total.cast("double"))


def exact_mean(value: Column) -> Column:
    """Mean of shares, summed as decimals so that the order of rows does not matter."""
    return F.avg(value.cast("decimal(18,9)")).cast("double")


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("bigint"))
