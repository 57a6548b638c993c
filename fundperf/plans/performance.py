"""Performance statistics of all funds together, of each fund and of each holding."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundperf.constants import HOLDING_KEY, REPORT_FUNDS, TOTAL_LABEL
from fundperf.functions.stats import (
    annualised_mean,
    annualised_volatility,
    compound_return,
    last_value,
    ols_alpha,
    ols_beta,
    period_alpha,
    ratio,
)
from fundperf.functions.text import titled
from fundperf.operators.benchmark import benchmark_join
from fundperf.operators.snapshots import ordered, ordered_few
from fundperf.plans.holdings import reported_holdings
from fundperf.plans.lookups import current_ticker_rows
from fundperf.plans.returns import (
    TablesLike,
    benchmark_daily_returns,
    fund_daily_returns,
    total_daily_returns,
)

TOTAL_MEASURES = (
    "total_return",
    "volatility",
    "dividends",
    "alpha",
    "beta",
    "tracking_error",
    "sharpe_ratio",
    "information_ratio",
)
FUND_MEASURES = (*TOTAL_MEASURES, "total_return_bmk")
REPORT_MEASURES = tuple(name for name in TOTAL_MEASURES if name != "dividends")
HOLDING_MEASURES = ("weight", "total_return", "volatility", "alpha", "beta")

# Benchmark returns that count as zero on days without a benchmark row.
ZERO_FILLED = ("div_return", "xs_return_bmk", "xs_div_return")

def _or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in columns})


def with_benchmark(series: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A fund series next to the benchmark. ``return_bmk`` stays NULL where there is none."""
    return _or_zero(benchmark_join(series, benchmark), ZERO_FILLED)


# Benchmark return and regressor by kind of benchmark, and how alpha is taken.
BENCHMARKS = {"price": ("return_bmk", "xs_return_bmk"), "dividends": ("div_return", "xs_div_return")}
ALPHAS = ("intercept", "period")


def _benchmark_columns(benchmark: str) -> tuple[Column, Column]:
    if benchmark not in BENCHMARKS:
        raise ValueError(f"unknown benchmark: {benchmark!r}")
    returns, regressor = BENCHMARKS[benchmark]
    return F.col(returns), F.col(regressor)


def _alpha(kind: str) -> Column:
    if kind not in ALPHAS:
        raise ValueError(f"unknown alpha: {kind!r}")
    return F.col("daily_alpha") if kind == "intercept" else _alpha_of_period()


def _fund_aggregates(bmk_return: Column, regressor: Column) -> list[Column]:
    day = F.col("caldt")
    xs = F.col("xs_return")
    residual = xs - F.col("xs_div_return")
    return [
        compound_return(F.col("return"), day).alias("total_return"),
        compound_return(bmk_return, day).alias("total_return_bmk"),
        annualised_volatility(F.col("return")).alias("volatility"),
        F.sum("dividends").alias("dividends"),
        ols_beta(xs, regressor).alias("beta"),
        ols_alpha(xs, regressor).alias("daily_alpha"),
        annualised_volatility(residual).alias("tracking_error"),
        annualised_mean(xs).alias("expected_return"),
    ]


def _with_ratios(stats: DataFrame, alpha: Column) -> DataFrame:
    return stats.withColumn("alpha", alpha).withColumns(
        {
            "sharpe_ratio": ratio(F.col("expected_return"), F.col("volatility")),
            "information_ratio": ratio(F.col("alpha"), F.col("tracking_error")),
        }
    )


def _alpha_of_period() -> Column:
    return period_alpha(F.col("total_return"), F.col("total_return_bmk"), F.col("beta"))


def total_performance(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    rf_fill: str = "reference",
    alpha: str = "intercept",
    benchmark: str = "dividends",
) -> DataFrame:
    """All funds as one line; by default against the dividend-inclusive benchmark, with a daily alpha."""
    series = with_benchmark(
        total_daily_returns(tables, start, end, rf_fill), benchmark_daily_returns(tables, start, end, rf_fill)
    )
    stats = series.agg(*_fund_aggregates(*_benchmark_columns(benchmark)))
    return _with_ratios(stats, _alpha(alpha)).select(*TOTAL_MEASURES)


def fund_performance(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
    alpha: str = "period",
    benchmark: str = "price",
) -> DataFrame:
    """One line per fund; by default against the price benchmark, with an alpha over the whole period."""
    series = with_benchmark(
        fund_daily_returns(tables, start, end, funds, rf_fill), benchmark_daily_returns(tables, start, end, rf_fill)
    )
    stats = series.groupBy("fund").agg(*_fund_aggregates(*_benchmark_columns(benchmark)))
    return _with_ratios(stats, _alpha(alpha)).select("fund", *FUND_MEASURES)


def performance_report(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] = REPORT_FUNDS,
    rf_fill: str = "reference",
    fund_series: DataFrame | None = None,
    benchmark_series: DataFrame | None = None,
) -> DataFrame:
    """The all-funds line and one line per fund, by title.

    Both kinds of series share one benchmark join and one aggregation; the line decides
    which benchmark return and which alpha applies. Series that are stored already can be given.
    """
    total = total_daily_returns(tables, start, end, rf_fill).withColumn("fund", F.lit(TOTAL_LABEL))
    if fund_series is None:
        fund_series = fund_daily_returns(tables, start, end, funds, rf_fill)
    if benchmark_series is None:
        benchmark_series = benchmark_daily_returns(tables, start, end, rf_fill)
    series = with_benchmark(fund_series.unionByName(total), benchmark_series)
    is_total = F.col("fund") == TOTAL_LABEL
    stats = series.groupBy("fund").agg(
        *_fund_aggregates(
            F.when(is_total, F.col("div_return")).otherwise(F.col("return_bmk")),
            F.when(is_total, F.col("xs_div_return")).otherwise(F.col("xs_return_bmk")),
        )
    )
    alpha = F.when(is_total, F.col("daily_alpha")).otherwise(_alpha_of_period())
    report = _with_ratios(stats, alpha).select(titled(F.col("fund")).alias("fund"), *REPORT_MEASURES)
    return ordered_few(report, "fund")


def holdings_performance(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = REPORT_FUNDS,
    rf_fill: str = "reference",
    benchmark_series: DataFrame | None = None,
) -> DataFrame:
    """One line per currently held ticker: dividend-inclusive on both sides, alpha over the period.

    Holdings that were sold are left out at the base tables, before any aggregation.
    """
    current = current_ticker_rows(tables, funds).distinct()
    held = reported_holdings(tables, start, end, funds, rf_fill, only=current)
    return holdings_statistics(tables, held, start, end, rf_fill, benchmark_series)


def holdings_statistics(
    tables: TablesLike,
    held: DataFrame,
    start: str | date,
    end: str | date,
    rf_fill: str = "reference",
    benchmark_series: DataFrame | None = None,
) -> DataFrame:
    """One line per holding of a daily holding series."""
    if benchmark_series is None:
        benchmark_series = benchmark_daily_returns(tables, start, end, rf_fill)
    joined = benchmark_join(held, benchmark_series, ("div_return", "xs_div_return"))
    series = _or_zero(joined, ("xs_div_return", "xs_div_return_bmk"))
    day, returns, regressor = F.col("caldt"), F.col("div_return"), F.col("xs_div_return_bmk")
    stats = series.groupBy(*HOLDING_KEY).agg(
        compound_return(returns, day).alias("total_return"),
        compound_return(F.col("div_return_bmk"), day).alias("total_return_bmk"),
        annualised_volatility(returns).alias("volatility"),
        ols_beta(F.col("xs_div_return"), regressor).alias("beta"),
        last_value(F.col("weight"), day).alias("weight"),
    )
    lines = stats.withColumn("alpha", _alpha_of_period()).select(*HOLDING_KEY, *HOLDING_MEASURES)
    return ordered(lines, *HOLDING_KEY)
