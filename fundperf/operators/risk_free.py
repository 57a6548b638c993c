"""Risk-free rates and excess returns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.operators.keys import daily_lookup


def risk_free_fill(
    series: DataFrame,
    rates: DataFrame,
    start: str | date,
    end: str | date,
    partition: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    rf_fill: str = "reference",
) -> DataFrame:
    """Join the daily risk-free rate as ``rf_return`` and fill days without one.

    ``rf_fill="reference"`` looks one row back with the days without a rate sorted last: the
    first such day of a partition gets the latest known rate, the others stay NULL.
    ``rf_fill="previous"`` carries the last known rate forward in date order.

    The rows of ``series`` must already be cut to the window. A partition holds at most one row
    per day and dividend action, whatever the size of the tables behind it.
    """
    daily = daily_lookup(rates, "risk-free rate", start, end).selectExpr(
        "caldt AS _rf_day", "return AS _rf"
    )
    columns = series.columns
    by = f"PARTITION BY {', '.join(partition)}" if partition else ""
    order = ", ".join(["caldt", *tie_break])
    if rf_fill == "reference":
        # Days with a rate, by date, then days without one: the row before the first of these is the last day
        # with a rate, and the row before a day with a NULL rate is the day with a rate before it. Stated
        # without sorting by _rf_day, so the partition's order by date serves all windows.
        place = f"struct({order})"
        first_missing = f"min(CASE WHEN _rf_day IS NULL THEN {place} END) OVER ({by})"
        latest = f"max_by(_rf, CASE WHEN _rf_day IS NOT NULL THEN {place} END) OVER ({by})"
        before = (
            f"last(CASE WHEN _rf_day IS NOT NULL THEN struct(_rf) END, true) "
            f"OVER ({by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)._rf"
        )
        filled = (
            f"CASE WHEN _rf_day IS NOT NULL THEN coalesce(_rf, {before}) "
            f"WHEN {place} <=> {first_missing} THEN {latest} END"
        )
    elif rf_fill == "previous":
        filled = f"last(_rf, true) OVER ({by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    else:
        raise ValueError(f"unknown rf_fill: {rf_fill!r}")
    joined = series.join(daily, F.expr("caldt = _rf_day"), "left")
    return joined.selectExpr(*[f"`{name}`" for name in columns], f"{filled} AS rf_return")


def excess(series: DataFrame, *returns: str) -> DataFrame:
    """``xs_<return>`` over the risk-free rate for each named return."""
    return series.selectExpr("*", *[f"{name} - rf_return AS xs_{name}" for name in returns])
