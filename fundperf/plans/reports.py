"""The printed reports: titled columns, percentages and two-decimal numbers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.constants import REPORT_FUNDS
from fundperf.functions.bounds import as_date
from fundperf.functions.text import as_number, as_percent, header
from fundperf.operators.snapshots import ordered_few
from fundperf.plans.performance import holdings_performance, performance_report
from fundperf.plans.returns import TablesLike, benchmark_frame, fund_daily_returns
from fundperf.plans.series import combined_return_series, fund_return_series, total_return_series
from fundperf.sources.sinks import write_report, write_series

OVERALL_PERCENT = ("total_return", "volatility", "tracking_error", "alpha")
OVERALL_NUMBER = ("beta", "sharpe_ratio", "information_ratio")
HOLDINGS_PERCENT = ("total_return", "volatility", "alpha", "weight")
HOLDINGS_NUMBER = ("beta",)


def formatted(df: DataFrame, percent: Sequence[str], number: Sequence[str]) -> DataFrame:
    def shown(name: str):
        if name in percent:
            return as_percent(F.col(name))
        return as_number(F.col(name)) if name in number else F.col(name)

    return df.select(*[shown(name).alias(header(name)) for name in df.columns])


def _formatted_overall(report: DataFrame) -> DataFrame:
    return formatted(report, OVERALL_PERCENT, OVERALL_NUMBER)


def _formatted_holdings(report: DataFrame) -> DataFrame:
    named = report.withColumn("fund", F.initcap(F.replace("fund", F.lit("_"), F.lit(" "))))
    return formatted(named, HOLDINGS_PERCENT, HOLDINGS_NUMBER)


def performance_report_formatted(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] = REPORT_FUNDS,
    rf_fill: str = "reference",
) -> DataFrame:
    return _formatted_overall(performance_report(tables, start, end, funds, rf_fill))


def holdings_report_formatted(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = REPORT_FUNDS,
    rf_fill: str = "reference",
) -> DataFrame:
    return _formatted_holdings(holdings_performance(tables, start, end, funds, rf_fill))


def write_annual_report(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    path: str,
    funds: Sequence[str] = REPORT_FUNDS,
    rf_fill: str = "reference",
    run: str | None = None,
) -> str:
    """Write both reports, as measures and as printed, and the series; returns the folder.

    The daily series of the funds and of the benchmark are computed once, stored, and read by whatever
    builds on them, as are the measures that the printed reports show. The measures carry the period.
    ``run`` names a subfolder, so that a failed run can be repeated beside its remains.

    Volatility and tracking error are annualised, weights are those of the last day; all other
    values are period totals.
    """
    folder = f"{path}/{run}" if run else path
    spark = tables["delta_nav"].sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        write_report(df, f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def with_period(df: DataFrame) -> DataFrame:
        return df.withColumns({"period_start": F.lit(as_date(start)), "period_end": F.lit(as_date(end))})

    daily = stored(fund_daily_returns(tables, start, end, funds, rf_fill), "fund_daily_returns")
    levels = stored(benchmark_frame(tables, start, end, rf_fill), "benchmark_daily_returns")
    returns = levels.drop("action_id")
    overall = stored(
        with_period(performance_report(tables, start, end, funds, rf_fill, daily, returns)), "overall_measures"
    )
    holdings = stored(
        with_period(holdings_performance(tables, start, end, funds, rf_fill, returns)), "holdings_measures"
    )
    period = ("period_start", "period_end")
    write_report(_formatted_overall(ordered_few(overall, "fund").drop(*period)), f"{folder}/overall_performance")
    write_report(_formatted_holdings(holdings.drop(*period)), f"{folder}/holdings_performance", partition_by="Fund")
    write_series(total_return_series(tables, start, end, rf_fill, levels), f"{folder}/total_return_series")
    write_series(
        fund_return_series(tables, start, end, funds, rf_fill, daily, levels), f"{folder}/fund_return_series"
    )
    write_series(
        combined_return_series(tables, start, end, funds, rf_fill, daily), f"{folder}/combined_return_series"
    )
    return folder
