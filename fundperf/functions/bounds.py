"""Date windows and the row bounds that follow from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast by hint only when its row count is known to stay below this.
# The rows concerned are a date, a fund name and one or two doubles.
BROADCAST_ROW_LIMIT = 100_000


def as_date(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def day_span(start: str | date, end: str | date) -> int:
    """Number of calendar days in the inclusive window, never negative."""
    return max((as_date(end) - as_date(start)).days + 1, 0)


def in_window(start: str | date, end: str | date, column: str = "caldt") -> Column:
    return F.col(column).between(F.lit(as_date(start)), F.lit(as_date(end)))


def broadcast_within(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Hint a broadcast when ``row_bound`` proves the side small.

    Without a bound, or beyond the limit, the choice is left to Spark's own size check:
    a static or adaptive broadcast below its threshold, a sort-merge join above it.
    """
    if row_bound is not None and row_bound <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df
