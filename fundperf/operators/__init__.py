from fundperf.operators.benchmark import benchmark_join
from fundperf.operators.carried import (
    action_state,
    actions_of,
    lag_from_state,
    last_state,
    merged_actions,
    merged_state,
)
from fundperf.operators.dividends import dividends_by_action, dividends_by_day, dividends_per_fund_day
from fundperf.operators.keys import daily_lookup, keyed_upsert, require_unique
from fundperf.operators.positions import (
    lag_state,
    lagged_position_state,
    net_trades,
    position_returns,
    position_snapshot,
    position_state,
    position_trade_merge,
    position_values,
)
from fundperf.operators.risk_free import excess, risk_free_fill
from fundperf.operators.sliced import lag_state_sliced, previous_value, running_returns
from fundperf.operators.snapshots import for_funds, latest_snapshot, on_trading_days

__all__ = [
    "action_state",
    "actions_of",
    "benchmark_join",
    "daily_lookup",
    "dividends_by_action",
    "dividends_by_day",
    "dividends_per_fund_day",
    "excess",
    "for_funds",
    "keyed_upsert",
    "lag_from_state",
    "lag_state",
    "lag_state_sliced",
    "lagged_position_state",
    "last_state",
    "latest_snapshot",
    "merged_actions",
    "merged_state",
    "net_trades",
    "on_trading_days",
    "position_returns",
    "position_snapshot",
    "position_state",
    "position_trade_merge",
    "position_values",
    "previous_value",
    "require_unique",
    "risk_free_fill",
    "running_returns",
]
