from fundperf.plans.holdings import all_holdings_daily_returns, holding_daily_returns
from fundperf.plans.factors import fund_factor_model
from fundperf.plans.lookups import (
    current_holdings,
    current_tickers,
    dividend_history,
    logs_by_fund,
    portfolio_defaults,
    recent_logs,
    ticker_universe,
    trade_history,
    traded_tickers,
    upsert_holding,
    upsert_holdings,
    upsert_portfolio,
    upsert_portfolios,
)
from fundperf.plans.performance import (
    fund_performance,
    holdings_performance,
    performance_report,
    total_performance,
)
from fundperf.plans.reports import (
    holdings_report_formatted,
    performance_report_formatted,
    write_annual_report,
)
from fundperf.plans.returns import benchmark_daily_returns, fund_daily_returns, total_daily_returns
from fundperf.plans.series import (
    combined_return_series,
    fund_return_series,
    total_return_series,
    total_return_series_scanned,
)

__all__ = [
    "all_holdings_daily_returns",
    "benchmark_daily_returns",
    "combined_return_series",
    "current_holdings",
    "current_tickers",
    "dividend_history",
    "fund_daily_returns",
    "fund_factor_model",
    "fund_performance",
    "fund_return_series",
    "holding_daily_returns",
    "holdings_performance",
    "holdings_report_formatted",
    "logs_by_fund",
    "performance_report",
    "performance_report_formatted",
    "portfolio_defaults",
    "recent_logs",
    "ticker_universe",
    "total_daily_returns",
    "total_performance",
    "total_return_series",
    "total_return_series_scanned",
    "trade_history",
    "traded_tickers",
    "upsert_holding",
    "upsert_holdings",
    "upsert_portfolio",
    "upsert_portfolios",
    "write_annual_report",
]
