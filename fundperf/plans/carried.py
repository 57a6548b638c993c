"""Holding returns of new days from a stored state, without reading the history behind it.

The state stands for all days up to ``as_of``: the last merged row of each holding, and the sums of each dividend
action. A run over later days reads the rows of these days only. Positions and trades that arrive late change
the past: the holdings concerned are worked out from their history again, the others keep their state. Late dividends need
no such thing, as their sums merge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundperf.constants import HOLDING_KEY, MONEY_MARKET_TICKER
from fundperf.functions.bounds import as_date, in_window
from fundperf.operators.carried import (
    action_state,
    actions_of,
    actions_paid,
    lag_from_state,
    last_state,
    merged_actions,
    merged_state,
)
from fundperf.operators.dividends import dividends_by_action
from fundperf.operators.positions import position_state, position_trade_merge
from fundperf.operators.snapshots import for_funds
from fundperf.plans.holdings import HOLDING_SERIES, returns_frame
from fundperf.plans.returns import TablesLike
from fundperf.sources.storage import stored


@dataclass(frozen=True)
class HoldingState:
    """What is carried from all days up to ``as_of``."""

    holdings: DataFrame
    actions: DataFrame
    as_of: date

    def save(self, path: str) -> HoldingState:
        """The state as two tables in a new folder, named by its day so that a later one can't take its place."""
        root = f"{path.rstrip('/')}/{self.as_of.isoformat()}"
        holdings, actions = stored(self.holdings, f"{root}/holdings"), stored(self.actions, f"{root}/actions")
        return HoldingState(holdings, actions, self.as_of)

    @classmethod
    def load(cls, spark: SparkSession, path: str, as_of: str | date) -> HoldingState:
        root = f"{path.rstrip('/')}/{as_date(as_of).isoformat()}"
        return cls(spark.read.parquet(f"{root}/holdings"), spark.read.parquet(f"{root}/actions"), as_date(as_of))


def _up_to(df: DataFrame, day: date) -> DataFrame:
    return df.filter(F.col("caldt") <= F.lit(day))


def _between(df: DataFrame, after: date, until: date) -> DataFrame:
    return df.filter(in_window(after + timedelta(days=1), until))


def _merged(tables: TablesLike, actions: DataFrame, cut) -> DataFrame:
    return position_trade_merge(cut(tables["positions"]), cut(tables["trades"]), actions)


def holding_state(tables: TablesLike, as_of: str | date) -> HoldingState:
    """The state after ``as_of`` from the full history."""
    day = as_date(as_of)
    past = _up_to(tables["dividends"], day)
    merged = _merged(tables, dividends_by_action(past), lambda df: _up_to(df, day))
    return HoldingState(last_state(merged), action_state(past), day)


def _new_rows(tables: TablesLike, state: HoldingState, until: date) -> DataFrame:
    """Merged rows of the days after the state up to ``until``."""
    paid = _between(tables["dividends"], state.as_of, until)
    # Only an action that starts in the new days meets a row of theirs, so of the state only the actions paid then count.
    starting = _between(actions_of(merged_actions(actions_paid(state.actions, paid), paid)), state.as_of, until)
    return _merged(tables, starting, lambda df: _between(df, state.as_of, until))


def advanced(tables: TablesLike, state: HoldingState, until: str | date) -> HoldingState:
    """The state after some more days; only these are read."""
    day = as_date(until)
    if day <= state.as_of:
        raise ValueError(f"the state stands for all days up to {state.as_of} already")
    rows = _new_rows(tables, state, day)
    actions = merged_actions(state.actions, _between(tables["dividends"], state.as_of, day))
    return HoldingState(merged_state(state.holdings, rows), actions, day)


def corrected(
    tables: TablesLike,
    state: HoldingState,
    positions: DataFrame | None = None,
    trades: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> HoldingState:
    """The state after late rows of days up to ``as_of``.

    ``tables`` hold the rows as they are now; ``positions`` and ``trades`` say which were added, changed or withdrawn:
    their holdings are worked out from the history again, at the base tables. ``dividends`` are added rows, which
    are summed into their actions; a changed or withdrawn dividend row needs a new state.
    """
    actions = state.actions if dividends is None else merged_actions(state.actions, _up_to(dividends, state.as_of))
    late = [_up_to(rows, state.as_of).select(*HOLDING_KEY) for rows in (positions, trades) if rows is not None]
    if not late:
        return HoldingState(state.holdings, actions, state.as_of)
    concerned = (late[0] if len(late) == 1 else late[0].unionByName(late[1])).distinct()
    keys = list(HOLDING_KEY)

    def of_concerned(df: DataFrame) -> DataFrame:
        return df.join(concerned, keys, "left_semi")

    def past(df: DataFrame) -> DataFrame:
        return of_concerned(_up_to(df, state.as_of))

    # Only the concerned holdings' actions are summed for them.
    own = of_concerned(state.actions)
    own = own if dividends is None else merged_actions(own, past(dividends))
    again = last_state(_merged(tables, _up_to(actions_of(own), state.as_of), past))
    untouched = state.holdings.join(concerned, keys, "left_anti")
    return HoldingState(untouched.unionByName(again), actions, state.as_of)


def holding_returns_from(
    tables: TablesLike,
    state: HoldingState,
    end: str | date,
    start: str | date | None = None,
    funds: Sequence[str] | None = None,
    rf_fill: str = "reference",
) -> DataFrame:
    """The series of all tickers but the money market fund, for days after the state.

    The same rows as ``all_holdings_daily_returns`` over the window, which begins on the day after the state if not
    stated. Positions, trades and dividends of earlier days are not read.
    """
    first = state.as_of + timedelta(days=1) if start is None else as_date(start)
    if first <= state.as_of:
        raise ValueError(f"the window must begin after the state's day, {state.as_of}")
    reported = F.col("ticker") != MONEY_MARKET_TICKER
    scoped = {name: for_funds(tables[name], funds).filter(reported) for name in ("positions", "trades", "dividends")}
    known = HoldingState(
        for_funds(state.holdings, funds).filter(reported), for_funds(state.actions, funds).filter(reported), state.as_of
    )
    rows = _new_rows(scoped, known, as_date(end))
    lagged = position_state(lag_from_state(known.holdings, rows))
    return returns_frame(tables, lagged, first, end, funds, rf_fill).select(*HOLDING_SERIES)
