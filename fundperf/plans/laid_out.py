"""Holding returns and current holdings from a laid-out history.

What the holdings look back on, positions and trades merged by day with their dividends, is stored once, by period and
bucket of holdings. A run then starts at its window: no aggregate, no join of the merge and no shuffle before it. The
rows of the last days come from the folders of their periods alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.constants import EXCLUDED_ASSET_CLASSES, MONEY_MARKET_TICKER
from fundperf.functions.bounds import as_date, broadcast_within
from fundperf.operators.dividends import dividends_by_action
from fundperf.operators.positions import lagged_position_state, position_trade_merge
from fundperf.operators.snapshots import for_funds
from fundperf.plans.holdings import HOLDING_SERIES, returns_frame
from fundperf.plans.performance import holdings_statistics
from fundperf.plans.returns import TablesLike
from fundperf.sources.layout import PERIOD, LaidOut, append_laid_out, enough_buckets, write_laid_out


def store_merged_days(tables: TablesLike, path: str, buckets: int, period: str = "month") -> LaidOut:
    """The merged rows of all days, one per day, holding and dividend action.

    In ``buckets`` buckets, or more if positions and trades are many; counting them reads no column.
    """
    buckets = enough_buckets(buckets, tables["positions"].count() + tables["trades"].count())
    merged = position_trade_merge(tables["positions"], tables["trades"], dividends_by_action(tables["dividends"]))
    return write_laid_out(merged, path, buckets, order=("caldt", "action_id"), period=period)


def append_merged_days(tables: TablesLike, path: str, after: str | date, until: str | date) -> LaidOut:
    """The layout with the merged rows of the days after ``after`` up to ``until``; only these days are added."""
    days = F.col("caldt").between(F.date_add(F.lit(as_date(after)), 1), F.lit(as_date(until)))
    actions = dividends_by_action(tables["dividends"].filter(F.col("caldt") <= F.lit(as_date(until)))).filter(days)
    merged = position_trade_merge(tables["positions"].filter(days), tables["trades"].filter(days), actions)
    return append_laid_out(tables["positions"].sparkSession, path, merged)


def store_positions(tables: TablesLike, path: str, files: int, period: str = "month") -> LaidOut:
    """The positions as booked, by period, in ``files`` files each or more; a holding may be booked any number of times."""
    return write_laid_out(tables["positions"], path, files, (), ("fund", "caldt"), period)


def latest_rows(positions: LaidOut, funds: Sequence[str] | None = None) -> DataFrame:
    """Rows on each fund's last day, from the folders of the periods these days fall in.

    The days come from the counts, so finding them opens no file of the rows.
    """
    last = for_funds(positions.last_days(), funds)
    periods = last.select(positions.period_of("caldt").alias(PERIOD)).distinct()
    found = [row[PERIOD] for row in periods.collect()]  # as many as the funds at most
    rows = for_funds(positions.rows, funds).filter(F.col(PERIOD).isin(found))
    bound = None if funds is None else len(funds)
    return rows.join(broadcast_within(last, bound), ["fund", "caldt"], "left_semi").select(*positions.rows.columns).drop(PERIOD)


def holding_returns_laid_out(
    tables: TablesLike,
    merged: LaidOut,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
    only: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``all_holdings_daily_returns`` from the layout.

    The history up to the window's end is read bucket by bucket, of the asked funds only; periods after it are not opened.
    """
    upto = (F.col(PERIOD) <= merged.period_at(as_date(end))) & (F.col("ticker") != MONEY_MARKET_TICKER)
    rows = for_funds(merged.rows, funds).filter(upto).drop(PERIOD)
    rows = rows if only is None else rows.join(only, ["fund", "ticker"], "left_semi")
    state = lagged_position_state(rows)
    return returns_frame(tables, state, start, end, funds, rf_fill).select(*HOLDING_SERIES)


def holdings_performance_laid_out(
    tables: TablesLike,
    merged: LaidOut,
    positions: LaidOut,
    start: str | date,
    end: str | date,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    """The lines of ``holdings_performance``: positions are read for the last days only, the merge not at all."""
    current = latest_rows(positions, funds).filter(~F.col("asset_class").isin(*EXCLUDED_ASSET_CLASSES))
    held = holding_returns_laid_out(
        tables, merged, start, end, funds, rf_fill, current.select("fund", "ticker").distinct()
    )
    return holdings_statistics(tables, held, start, end, rf_fill)
