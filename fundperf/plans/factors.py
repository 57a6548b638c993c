"""Regressions of fund returns on several factors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.functions.least_squares import least_squares
from fundperf.functions.stats import ratio
from fundperf.plans.performance import with_benchmark
from fundperf.plans.returns import TablesLike, benchmark_daily_returns, fund_daily_returns

#: What can explain a fund's excess return: the benchmark's, its dividends, and the fund's own.
FACTORS = ("xs_return_bmk", "xs_div_return", "paid", "payout")


def fund_factor_model(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    factors: Sequence[str] = ("xs_return_bmk", "payout"),
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    """One line per fund: daily intercept and a beta per factor of its excess return.

    ``xs_return_bmk`` and ``xs_div_return`` are the benchmark's excess returns, ``paid`` their difference and ``payout``
    the fund's dividends over its starting value.
    """
    unknown = set(factors) - set(FACTORS)
    if unknown or not factors:
        raise ValueError(f"unknown factors: {sorted(unknown)}" if unknown else "no factors")
    series = with_benchmark(
        fund_daily_returns(tables, start, end, funds, rf_fill), benchmark_daily_returns(tables, start, end, rf_fill)
    ).withColumns(
        {
            "paid": F.col("xs_div_return") - F.col("xs_return_bmk"),
            "payout": ratio(F.col("dividends"), F.col("starting_value")),
        }
    )
    return least_squares(series, ["fund"], "xs_return", factors)
