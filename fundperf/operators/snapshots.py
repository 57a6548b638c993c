"""Latest rows, trading days and ticker selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundperf.functions.bounds import broadcast_within


def for_funds(
    df: DataFrame, funds: Sequence[str] | None = None, tickers: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the given funds and tickers; None means all, an empty list means none."""
    if funds is not None:
        df = df.filter(F.col("fund").isin(list(funds)))
    if tickers is not None:
        df = df.filter(F.col("ticker").isin(list(tickers)))
    return df


def latest_snapshot(df: DataFrame, funds: Sequence[str] | None = None) -> DataFrame:
    """Rows on each fund's last day.

    With named funds the per-fund dates are as few as the names and are broadcast. Otherwise
    a scalar subquery first drops every day before the earliest of the last days, so whatever
    join Spark chooses afterwards sees only the tail of the table.
    """
    scoped = for_funds(df, funds)
    latest = scoped.groupBy("fund").agg(F.max("caldt").alias("caldt"))
    if funds is None:
        scoped = scoped.filter(F.col("caldt") >= latest.select(F.min("caldt")).scalar())
    bound = None if funds is None else len(funds)
    return scoped.join(broadcast_within(latest, bound), ["fund", "caldt"], "left_semi")


def on_trading_days(df: DataFrame, calendar: DataFrame, days: int | None = None) -> DataFrame:
    """Rows on days of the calendar. ``days`` bounds the calendar when both sides share a window."""
    return df.join(broadcast_within(calendar.select("caldt").distinct(), days), "caldt", "left_semi")


def ordered(df: DataFrame, *by: str | Column) -> DataFrame:
    """Globally sorted rows.

    A range sort samples its input by running it. Rebalancing the finished rows first makes it
    sample shuffle files instead of computing everything behind them twice. A hash of the row as
    last key lets rows with equal keys, such as one busy day, spread over several ranges; being
    deterministic, it lets conditions on the result move down to the files.
    """
    spread = df.withColumn("_spread", F.xxhash64(*df.columns)).hint("rebalance")
    return spread.orderBy(*by, "_spread").drop("_spread")


def ordered_few(df: DataFrame, *by: str | Column) -> DataFrame:
    """Sorted rows of a result that is known to be small, such as one row per fund, in one partition."""
    return df.repartition(1).sortWithinPartitions(*by)
