"""Daily return series of all funds together, of each fund and of the benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.constants import BENCHMARK_PROXY_FUND, BENCHMARK_PROXY_TICKER
from fundperf.functions.bounds import broadcast_within, day_span, in_window
from fundperf.operators.dividends import dividends_by_action, dividends_by_day, dividends_per_fund_day
from fundperf.operators.keys import require_unique
from fundperf.operators.risk_free import excess, risk_free_fill
from fundperf.operators.sliced import previous_value
from fundperf.operators.snapshots import for_funds

TablesLike = Mapping[str, DataFrame]

FUND_SERIES = (
    "caldt",
    "fund",
    "starting_value",
    "ending_value",
    "dividends",
    "return",
    "rf_return",
    "xs_return",
)
TOTAL_SERIES = tuple(name for name in FUND_SERIES if name != "fund")
BENCHMARK_SERIES = (
    "caldt",
    "starting_value",
    "ending_value",
    "dividends",
    "dividend_yield",
    "return",
    "div_return",
    "rf_return",
    "xs_return",
    "xs_div_return",
)


def _moving_days(values: DataFrame) -> DataFrame:
    """Daily return of the days that have one and moved; without a start value there is none."""
    return values.selectExpr("*", "try_divide(ending_value, starting_value) - 1 AS return").filter("return <> 0")


def _with_dividends(moves: DataFrame, paid: DataFrame, keys: Sequence[str]) -> DataFrame:
    columns = moves.columns
    return moves.join(paid, list(keys), "left").selectExpr(
        *columns, "coalesce(dividends, 0D) AS dividends"
    )


def _fund_values(
    tables: TablesLike, start: str | date, end: str | date, funds: Sequence[str] | None = None
) -> DataFrame:
    """The window's delta_nav; a day given twice for a fund fails the job."""
    rows = for_funds(tables["delta_nav"], funds).filter(in_window(start, end))
    values = rows.select("caldt", "fund", "starting_value", "ending_value", "deposits_withdrawals")
    return require_unique(values, ["caldt", "fund"], "delta_nav")


def total_moves(tables: TablesLike, start: str | date, end: str | date) -> DataFrame:
    """All funds as one series with dividends, without the risk-free rate. Deposits and withdrawals are not taken out here."""
    window = in_window(start, end)
    values = (
        _fund_values(tables, start, end)
        .groupBy("caldt")
        .agg(F.sum("starting_value").alias("starting_value"), F.sum("ending_value").alias("ending_value"))
    )
    # One row per day on the right: the day count bounds it.
    paid = broadcast_within(dividends_by_day(tables["dividends"].filter(window)), day_span(start, end))
    return _with_dividends(_moving_days(values), paid, ["caldt"])


def total_daily_returns(
    tables: TablesLike, start: str | date, end: str | date, rf_fill: str = "reference"
) -> DataFrame:
    """The series of all funds together with excess returns."""
    series = total_moves(tables, start, end)
    filled = risk_free_fill(series, tables["risk_free_rate"], start, end, rf_fill=rf_fill)
    return excess(filled, "return").select(*TOTAL_SERIES)


def fund_moves(
    tables: TablesLike, start: str | date, end: str | date, funds: Sequence[str] | None = None
) -> DataFrame:
    """Each fund's series with dividends, net of deposits and withdrawals, without the risk-free rate."""
    window = in_window(start, end)
    values = _fund_values(tables, start, end, funds).selectExpr(
        "caldt", "fund", "starting_value", "ending_value - deposits_withdrawals AS ending_value"
    )
    # The first day of an action may lie before the window, so the cut follows the grouping.
    actions = dividends_by_action(for_funds(tables["dividends"], funds))
    paid = dividends_per_fund_day(actions.filter(window))
    bound = None if funds is None else day_span(start, end) * len(funds)
    return _with_dividends(_moving_days(values), broadcast_within(paid, bound), ["caldt", "fund"])


def fund_daily_returns(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    """Each fund's series with excess returns; all funds in one pass."""
    series = fund_moves(tables, start, end, funds)
    filled = risk_free_fill(
        series, tables["risk_free_rate"], start, end, partition=["fund"], rf_fill=rf_fill
    )
    return excess(filled, "return").select(*FUND_SERIES)


def benchmark_moves(
    tables: TablesLike, start: str | date, end: str | date, pieces: int | None = None
) -> DataFrame:
    """The benchmark series with the dividend action behind each row, without the risk-free rate.

    With ``pieces`` the previous levels are found in as many ranges of days, instead of one task.
    """
    levels = require_unique(
        tables["benchmark"].select("caldt", "ending_value"), ["caldt"], "benchmark"
    )
    actions = dividends_by_action(
        for_funds(tables["dividends"], [BENCHMARK_PROXY_FUND], [BENCHMARK_PROXY_TICKER])
    ).selectExpr("caldt", "action_id", "action_rate AS dividends")
    # The previous level comes from the whole history, one row per day; the window cut follows.
    if pieces is None:
        followed = levels.selectExpr("*", "lag(ending_value) OVER (ORDER BY caldt) AS starting_value")
    else:
        followed = previous_value(levels, "ending_value", "starting_value", pieces=pieces)
    moves = followed.filter(in_window(start, end)).filter("try_divide(ending_value, starting_value) <> 1")
    return moves.join(actions, "caldt", "left").selectExpr(
        "*",
        "try_divide(dividends, ending_value) AS dividend_yield",
        "try_divide(ending_value, starting_value) - 1 AS return",
        "try_divide(ending_value + coalesce(dividends, 0D), starting_value) - 1 AS div_return",
    )


def benchmark_frame(
    tables: TablesLike, start: str | date, end: str | date, rf_fill: str = "reference"
) -> DataFrame:
    """The benchmark series with excess returns and the dividend action behind each row."""
    series = benchmark_moves(tables, start, end)
    filled = risk_free_fill(
        series, tables["risk_free_rate"], start, end, tie_break=["action_id"], rf_fill=rf_fill
    )
    return excess(filled, "return", "div_return").select(*BENCHMARK_SERIES, "action_id")


def benchmark_daily_returns(
    tables: TablesLike, start: str | date, end: str | date, rf_fill: str = "reference"
) -> DataFrame:
    """Price and dividend-inclusive return of the benchmark, with excess returns."""
    return benchmark_frame(tables, start, end, rf_fill).select(*BENCHMARK_SERIES)
