"""Look-ups on positions, dividends, trades, logs and settings, and the keyed writes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.constants import EXCLUDED_ASSET_CLASSES, RECENT_LOG_DAYS, REPORT_FUNDS
from fundperf.functions.bounds import as_date, broadcast_within, in_window
from fundperf.operators.dividends import dividends_by_action
from fundperf.operators.keys import keyed_upsert, require_unique
from fundperf.operators.snapshots import for_funds, latest_snapshot, ordered
from fundperf.plans.returns import TablesLike
from fundperf.sources.schemas import KEYS, SCHEMAS


def _ordinary(positions: DataFrame) -> DataFrame:
    return positions.filter(~F.col("asset_class").isin(*EXCLUDED_ASSET_CLASSES))


def traded_tickers(
    tables: TablesLike, start: str | date, end: str | date, funds: Sequence[str] | None = None
) -> DataFrame:
    """Distinct tickers held in the window, by fund."""
    held = _ordinary(for_funds(tables["positions"], funds)).filter(in_window(start, end))
    return ordered(held.select("fund", "ticker").distinct(), "fund", "ticker")


def current_ticker_rows(tables: TablesLike, funds: Sequence[str] | None = None) -> DataFrame:
    """Tickers on each fund's last position day, as often as they are booked, unsorted."""
    # The last day is that of all positions; options and cash go afterwards.
    return _ordinary(latest_snapshot(tables["positions"], funds)).select("fund", "ticker")


def current_tickers(tables: TablesLike, funds: Sequence[str] | None = None) -> DataFrame:
    return ordered(current_ticker_rows(tables, funds), "fund", "ticker")


def dividend_history(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    fund: str | None = None,
    ticker: str | None = None,
) -> DataFrame:
    """Dividend actions from the rows inside the window."""
    rows = for_funds(
        tables["dividends"], None if fund is None else [fund], None if ticker is None else [ticker]
    ).filter(in_window(start, end))
    actions = dividends_by_action(rows).selectExpr(
        "fund",
        "caldt",
        "ticker",
        "action_id",
        "action_rate AS gross_rate",
        "action_amount AS gross_amount",
    )
    return ordered(actions, "caldt")


def trade_history(
    tables: TablesLike,
    start: str | date,
    end: str | date,
    fund: str | None = None,
    ticker: str | None = None,
) -> DataFrame:
    """Trades per day and direction; the value is total shares times average price."""
    rows = for_funds(
        tables["trades"], None if fund is None else [fund], None if ticker is None else [ticker]
    ).filter(in_window(start, end))
    traded = (
        rows.groupBy("caldt", "fund", "ticker", "buy_sell")
        .agg(F.sum("shares_traded").alias("shares"), F.avg("price_traded").alias("price"))
        .selectExpr(
            "caldt", "fund", "ticker", "shares", "price", "shares * price AS value", "buy_sell AS side"
        )
    )
    return ordered(traded, "caldt")


def recent_logs(tables: TablesLike, days: int = RECENT_LOG_DAYS) -> DataFrame:
    """All log rows of the latest distinct days."""
    latest = tables["logs"].select("caldt").distinct().orderBy(F.desc("caldt")).limit(days)
    return ordered(tables["logs"].join(broadcast_within(latest, days), "caldt", "left_semi"), F.desc("caldt"))


def logs_by_fund(
    tables: TablesLike, start: str | date, end: str | date, funds: Sequence[str]
) -> DataFrame:
    return for_funds(tables["logs"], funds).filter(in_window(start, end))


def portfolio_defaults(tables: TablesLike, fund: str | None = None) -> DataFrame:
    return for_funds(tables["portfolio"], None if fund is None else [fund])


def current_holdings(tables: TablesLike, funds: Sequence[str] | None = None) -> DataFrame:
    """Last-day positions with value, weight and the targets set for them.

    Positions without a stock value on that day drop out, those without targets stay.
    """
    held = latest_snapshot(tables["positions"], funds)
    nav = require_unique(
        for_funds(tables["nav"], funds).select("caldt", "fund", "stock"), ["caldt", "fund"], "nav"
    )
    return (
        held.join(nav, ["caldt", "fund"])
        .join(for_funds(tables["holding"], funds), ["fund", "ticker"], "left")
        .selectExpr(
            "fund",
            "ticker",
            "shares",
            "price",
            "price * shares AS value",
            "horizon_date",
            "target_price",
            "try_divide(price * shares, stock) AS weight",
        )
    )


def ticker_universe(
    tables: TablesLike, day: str | date, funds: Sequence[str] = REPORT_FUNDS
) -> DataFrame:
    """Ticker lists of a day in long form: one per listed fund, and ``all_tickers``.

    A fund's tickers repeat as often as they are booked. ``all_tickers`` holds each ticker of
    any fund once. A listed fund without positions has a single row with a NULL ticker. Rows
    instead of arrays keep a large list from gathering in one task.
    """
    booked = tables["positions"].filter(F.col("caldt") == F.lit(as_date(day)))
    lists = booked.filter(F.col("fund").isin(list(funds))).select(F.col("fund").alias("universe"), "ticker")
    names = F.explode(F.array(*[F.lit(name) for name in funds]))
    listed = booked.sparkSession.range(1).select(names.alias("universe"))
    empty = listed.join(lists.select("universe").distinct(), "universe", "left_anti").select(
        "universe", F.lit(None).cast("string").alias("ticker")
    )
    union_list = booked.select(F.lit("all_tickers").alias("universe"), "ticker").distinct()
    return lists.unionByName(empty).unionByName(union_list)


def _upsert_row(tables: TablesLike, table: str, row: tuple) -> DataFrame:
    updates = tables[table].sparkSession.createDataFrame([row], SCHEMAS[table])
    return _upsert(tables, table, updates, 1)


def _upsert(tables: TablesLike, table: str, updates: DataFrame, row_bound: int | None) -> DataFrame:
    keys = KEYS[table]
    set_cols = [name for name in SCHEMAS[table].names if name not in keys]
    return keyed_upsert(tables[table], updates, keys, set_cols, row_bound)


def upsert_portfolio(
    tables: TablesLike, fund: str, benchmark_return: float | None, target_tracking_error: float | None
) -> DataFrame:
    """The settings table after setting one fund's values."""
    return _upsert_row(tables, "portfolio", (fund, benchmark_return, target_tracking_error))


def upsert_portfolios(
    tables: TablesLike, updates: DataFrame, row_bound: int | None = None
) -> DataFrame:
    """The settings table after a batch of at most ``row_bound`` rows, if that is known."""
    return _upsert(tables, "portfolio", updates, row_bound)


def upsert_holding(
    tables: TablesLike,
    fund: str,
    ticker: str,
    horizon_date: str | date | None,
    target_price: float | None,
) -> DataFrame:
    """The targets table after setting one holding's values."""
    horizon = None if horizon_date is None else as_date(horizon_date)
    return _upsert_row(tables, "holding", (fund, ticker, horizon, target_price))


def upsert_holdings(
    tables: TablesLike, updates: DataFrame, row_bound: int | None = None
) -> DataFrame:
    """The targets table after a batch of at most ``row_bound`` rows, if that is known."""
    return _upsert(tables, "holding", updates, row_bound)
