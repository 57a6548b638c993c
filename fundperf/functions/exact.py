"""Sums that don't depend on the order in which tasks deliver their parts.

The last bits of a sum of doubles depend on the order of addition, so a repeated run, another partitioning or a lost
executor may change a reported figure. Here each value is first rounded to a decimal of fixed places; decimals add up
exactly, in any order. A value too large for the decimal, or not finite, fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of money amounts, prices and rates, and of squares of returns.
MONEY_PLACES, SQUARE_PLACES = 9, 20
DIGITS = 38


def _decimal(value: Column, places: int) -> Column:
    # The cast itself fails for numbers too large, but takes others that are no finite number for NULL.
    finite = value.isNull() | (F.abs(value) < float("inf"))
    return F.when(finite, value.cast(f"decimal({DIGITS}, {places})")).otherwise(F.raise_error(F.lit("not a finite number")))


def exact_sum(value: Column, places: int = MONEY_PLACES) -> Column:
    """The sum of the values rounded to ``places``; NULL without values."""
    return F.sum(_decimal(value, places)).cast("double")


def exact_avg(value: Column, places: int = MONEY_PLACES) -> Column:
    """Their average: the exact sum over the count."""
    return exact_sum(value, places) / F.nullif(F.count(value), F.lit(0))


def exact_std(value: Column, places: int = SQUARE_PLACES) -> Column:
    """Sample standard deviation of numbers about the size of returns, from exact sums of values and squares."""
    n, total, squares = F.count(value), exact_sum(value, places), exact_sum(value * value, places)
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n - 1)))


def sum_of(value: Column, exact: bool) -> Column:
    return exact_sum(value) if exact else F.sum(value)


def avg_of(value: Column, exact: bool) -> Column:
    return exact_avg(value) if exact else F.avg(value)
