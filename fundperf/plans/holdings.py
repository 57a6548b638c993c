"""Daily return series of single holdings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundperf.constants import HOLDING_KEY, MONEY_MARKET_TICKER, POSITION_KEY
from fundperf.functions.bounds import broadcast_within, day_span, in_window
from fundperf.operators.dividends import dividends_by_action
from fundperf.operators.keys import require_unique
from fundperf.operators.positions import (
    lagged_position_state,
    position_returns,
    position_trade_merge,
    position_values,
)
from fundperf.operators.risk_free import excess, risk_free_fill
from fundperf.operators.snapshots import for_funds, on_trading_days
from fundperf.plans.returns import TablesLike

HOLDING_SERIES = (
    "caldt",
    "fund",
    "ticker",
    "side",
    "price",
    "shares",
    "fx_rate",
    "value",
    "weight",
    "dividend_yield",
    "dividends",
    "return",
    "div_return",
    "rf_return",
    "xs_return",
    "xs_div_return",
)


def holding_frame(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    tickers: Sequence[str] | None = None,
    keep: Column | None = None,
    rf_fill: str = "reference",
    only: DataFrame | None = None,
) -> DataFrame:
    """Holding series with the dividend action behind each row.

    Fund and ticker conditions, and the (fund, ticker) rows of ``only``, go to the base tables: the
    optimizer does not push them below the merge. Previous states come from the whole history; the window cut follows them.
    """

    def scoped(name: str) -> DataFrame:
        df = for_funds(tables[name], funds, tickers)
        df = df if keep is None else df.filter(keep)
        return df if only is None else df.join(only, list(HOLDING_KEY), "left_semi")

    merged = position_trade_merge(
        scoped("positions"), scoped("trades"), dividends_by_action(scoped("dividends"))
    )
    return returns_frame(tables, lagged_position_state(merged), start, end, funds, rf_fill)


def returns_frame(
    tables: TablesLike,
    state: DataFrame,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    """Holding series of a window from the state before and after each of its days."""
    days = day_span(start, end)
    window = in_window(start, end)
    values = on_trading_days(
        position_values(state).filter(window),
        tables["calendar"].filter(window),
        days,
    )
    nav = require_unique(
        for_funds(tables["nav"], funds).filter(window).select("caldt", "fund", "stock"), ["caldt", "fund"], "nav"
    )
    returns = position_returns(values, nav if funds is None else broadcast_within(nav, days * len(funds)))
    filled = risk_free_fill(
        returns,
        tables["risk_free_rate"],
        start,
        end,
        partition=HOLDING_KEY,
        tie_break=["action_id"],
        rf_fill=rf_fill,
    )
    named = filled.selectExpr(
        *POSITION_KEY,
        "action_id",
        "side",
        "price_1 AS price",
        "shares_1 AS shares",
        "fx_rate_1 AS fx_rate",
        "value_1 AS value",
        "weight_after AS weight",
        "try_divide(action_rate, price_1) AS dividend_yield",
        "dividends",
        "return",
        "div_return",
        "rf_return",
    )
    return excess(named, "return", "div_return").select(*HOLDING_SERIES, "action_id")


def holding_daily_returns(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    fund: str | None = None,
    ticker: str | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    """The series of one holding, or of every holding, money market included."""
    return holding_frame(
        tables,
        start,
        end,
        None if fund is None else [fund],
        None if ticker is None else [ticker],
        rf_fill=rf_fill,
    ).select(*HOLDING_SERIES)


def reported_holdings(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
    only: DataFrame | None = None,
) -> DataFrame:
    """Holding frame of all tickers but the money market fund, or of those in ``only``."""
    keep = F.col("ticker") != MONEY_MARKET_TICKER
    return holding_frame(tables, start, end, funds, keep=keep, rf_fill=rf_fill, only=only)


def all_holdings_daily_returns(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    return reported_holdings(tables, start, end, funds, rf_fill).select(*HOLDING_SERIES)
