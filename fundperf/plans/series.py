"""Cumulative return series, in percent."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundperf.constants import REPORT_FUNDS
from fundperf.functions.bounds import as_date
from fundperf.functions.stats import running_return
from fundperf.operators.benchmark import benchmark_join
from fundperf.operators.sliced import running_returns
from fundperf.plans.returns import (
    TablesLike,
    benchmark_frame,
    benchmark_moves,
    fund_daily_returns,
    total_daily_returns,
    total_moves,
)


def _by_day(*partition: str, tie_break: Sequence[str] = ()):
    over = Window.partitionBy(*partition) if partition else Window
    return over.orderBy("caldt", *tie_break).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumulative_return(
    series: DataFrame,
    column: str,
    name: str,
    partition: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Add the return compounded from the first day up to each row."""
    window = _by_day(*partition, tie_break=tie_break)
    return series.withColumn(name, running_return(F.col(column), window))


def _with_benchmark_line(series: DataFrame, benchmark: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Fund line and benchmark line; the benchmark pays nothing on days without a level."""
    joined = benchmark_join(series, benchmark, ("div_return", "action_id"))
    filled = joined.withColumn("div_return", F.coalesce("div_return", F.lit(0.0)))
    for column, name in (("return", "cumulative_return"), ("div_return", "cumulative_return_bmk")):
        filled = cumulative_return(filled, column, name, partition, ["action_id"])
        filled = filled.withColumn(name, F.col(name) * 100.0)
    return filled.select(*partition, "caldt", "cumulative_return", "cumulative_return_bmk")


def total_return_series(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    rf_fill: str = "reference",
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """All funds together; a stored ``benchmark_frame`` can be given."""
    if benchmark is None:
        benchmark = benchmark_frame(tables, start, end, rf_fill)
    return _with_benchmark_line(total_daily_returns(tables, start, end, rf_fill), benchmark, [])


def total_return_series_scanned(
    tables: TablesLike, start: str | date, end: str | date, pieces: int = 8
) -> DataFrame:
    """The rows of ``total_return_series`` by prefix scan over ranges of days; a task has one range, none has all rows."""
    benchmark = benchmark_moves(tables, start, end, pieces)
    joined = benchmark_join(total_moves(tables, start, end), benchmark, ("div_return", "action_id"))
    lines = {
        "cumulative_return": F.col("return"),
        "cumulative_return_bmk": F.coalesce(F.col("div_return"), F.lit(0.0)),
    }
    scanned = running_returns(joined, lines, ("caldt", "action_id"), pieces, (as_date(start), as_date(end)))
    return scanned.select("caldt", *[(F.col(name) * 100.0).alias(name) for name in lines])


def fund_return_series(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = REPORT_FUNDS,
    rf_fill: str = "reference",
    series: DataFrame | None = None,
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """Each fund; stored ``fund_daily_returns`` and a stored ``benchmark_frame`` can be given."""
    if series is None:
        series = fund_daily_returns(tables, start, end, funds, rf_fill)
    if benchmark is None:
        benchmark = benchmark_frame(tables, start, end, rf_fill)
    return _with_benchmark_line(series, benchmark, ["fund"])


def combined_return_series(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = REPORT_FUNDS,
    rf_fill: str = "reference",
    series: DataFrame | None = None,
) -> DataFrame:
    """The funds' own lines in one frame."""
    if series is None:
        series = fund_daily_returns(tables, start, end, funds, rf_fill)
    lines = cumulative_return(series, "return", "cumulative_return", ["fund"])
    return lines.select("fund", "caldt", (F.col("cumulative_return") * 100.0).alias("cumulative_return"))
