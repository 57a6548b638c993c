"""Performance statistics as aggregate and window expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from fundperf.constants import TRADING_DAYS_PER_YEAR


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with NULL for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


def present_on(day: Column, value: Column) -> Column:
    """Ascending integer of (day, value present); the last bit tells the presence."""
    return F.unix_date(day) * 2 + value.isNotNull().cast("int")


def compound_return(returns: Column, day: Column) -> Column:
    """Period return of a daily series, NULL when its last day has no return.

    Missing days inside the period are skipped. Log returns would not do: daily returns
    below -1 occur for short positions and closing trades.
    """
    has_last = F.max(present_on(day, returns)).bitwiseAND(1) == 1
    return F.when(has_last, F.product(returns + 1.0) - 1.0)


def last_value(value: Column, day: Column) -> Column:
    """Value of the last day, NULL if that day has none."""
    return F.max_by(value, present_on(day, value))


def running_return(returns: Column, window: WindowSpec) -> Column:
    """Compounded return up to each row, NULL on rows without a daily return."""
    return F.when(returns.isNotNull(), F.product(returns + 1.0).over(window) - 1.0)


def annualised_volatility(returns: Column) -> Column:
    return F.stddev_samp(returns) * F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR)))


def annualised_mean(returns: Column) -> Column:
    return F.avg(returns) * F.lit(float(TRADING_DAYS_PER_YEAR))


def ols_beta(y: Column, x: Column) -> Column:
    """Least-squares slope over the pairs without NULL; NULL for a constant regressor."""
    return F.regr_slope(y, x)


def ols_alpha(y: Column, x: Column) -> Column:
    """Least-squares intercept over the same pairs, in units of one day."""
    return F.regr_intercept(y, x)


def period_alpha(total: Column, benchmark_total: Column, beta: Column) -> Column:
    return total - beta * benchmark_total
