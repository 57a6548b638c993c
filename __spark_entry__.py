
from __future__ import annotations

import importlib
import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fundperf import operators, plans  # noqa: E402
from fundperf.functions import stats  # noqa: E402
from fundperf.functions.bounds import in_window  # noqa: E402
from fundperf.operators.dividends import dividends_by_action  # noqa: E402
from fundperf.plans import carried, laid_out, published, stored_statistics  # noqa: E402
from fundperf.plans.performance import with_benchmark  # noqa: E402
from fundperf.plans.series import cumulative_return  # noqa: E402
from fundperf.sources import Tables, VersionedTable, demo_tables, shared_folder  # noqa: E402
from oracle.queries import ORACLES  # noqa: E402

ENTRY_DIR = "/root/testdata/sf0.001"

# Parameters of all queries (see FIXTURES.md).
START, END = "1995-07-01", "2001-06-29"
UNIVERSE_DAY = "2001-06-25"
LOG_START, LOG_END, LOG_FUNDS = "2024-01-10", "2024-01-20", ("grad", "quant")
PORTFOLIO_BATCH = [("grad", 0.09, 0.04), ("omega", 0.07, None)]
# A state of April carried to the end of May, and the days that are worked out from it.
FIRST_STATE, STATE_DAY, LAST_DAY = "2001-04-30", "2001-05-31", "2001-06-29"
# A window that cuts months at both ends.
CUT_START, CUT_END = "1996-02-14", "2000-09-20"
HOLDING_FILES = 8
LAG_COLUMNS = ("caldt", "fund", "ticker", "action_id", "previous_side", "previous_shares", "previous_price", "previous_fx_rate")
# Buckets and folders of laid-out tables; the test tables are small, so a folder holds a year.
BUCKETS, PERIOD = 8, "year"


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places, halves upwards; the SQL does the same arithmetic."""
    unit = f"1e{places}D"
    return df.selectExpr(
        *[
            f"floor(`{name}` * {unit} + 0.5D) / {unit} AS `{name}`" if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


def _merge(t: Tables) -> DataFrame:
    return operators.position_trade_merge(
        t["positions"], t["trades"], dividends_by_action(t["dividends"])
    )


def _values(t: Tables) -> DataFrame:
    return operators.position_values(operators.lagged_position_state(_merge(t)))


def _fund_series(t: Tables) -> DataFrame:
    return plans.fund_daily_returns(t, START, END)


def _fund_and_benchmark(t: Tables) -> DataFrame:
    return with_benchmark(_fund_series(t), plans.benchmark_daily_returns(t, START, END))


def _risk_free_fill(t: Tables) -> DataFrame:
    days = t["delta_nav"].select("caldt", "fund").filter(in_window(START, END))
    return operators.risk_free_fill(days, t["risk_free_rate"], START, END, partition=["fund"])


def _benchmark_join(t: Tables) -> DataFrame:
    return operators.benchmark_join(
        _fund_series(t).select("caldt", "fund", "return", "xs_return"),
        plans.benchmark_daily_returns(t, START, END),
    )


def _fresh_targets(t: Tables) -> DataFrame:
    """Targets for every holding on a last position day: updates and inserts."""
    held = operators.latest_snapshot(t["positions"])
    return held.groupBy("fund", "ticker").agg(
        F.date_add(F.max("caldt"), 180).alias("horizon_date"),
        (F.max("price") * 1.25).alias("target_price"),
    )


def _upsert_holding(t: Tables) -> DataFrame:
    return plans.upsert_holdings(t, _fresh_targets(t))


def _published_targets(t: Tables) -> VersionedTable:
    """All targets, then fresh ones, then those of one fund raised: three versions."""
    spark = t["holding"].sparkSession
    table = published.publish_table(spark, t, "holding", shared_folder(spark), HOLDING_FILES)
    published.publish_upsert(table, "holding", _fresh_targets(t), batch="fresh")
    raised = table.read().filter("fund = 'quant'").selectExpr(
        "fund", "ticker", "date_add(horizon_date, 30) AS horizon_date", "target_price * 2 AS target_price"
    )
    published.publish_upsert(table, "holding", raised)
    return table


def _published_portfolio(t: Tables) -> DataFrame:
    """The settings in all their versions: two writers start from the first, one has to start again, one sends twice."""
    spark = t["portfolio"].sparkSession
    table = published.publish_table(spark, t, "portfolio", shared_folder(spark), 1)
    base = table.version()
    for batch, row in zip(("one", "two", "two"), (*PORTFOLIO_BATCH, PORTFOLIO_BATCH[1])):
        updates = spark.createDataFrame([row], t["portfolio"].schema)
        published.publish_upsert(table, "portfolio", updates, 1, batch, base)
    versions = [table.read(n).withColumn("version", F.lit(n).cast("long")) for n in table.numbers()]
    whole = versions[0]
    for version in versions[1:]:
        whole = whole.unionByName(version)
    return whole


def _carried_state(t: Tables) -> carried.HoldingState:
    """The state at STATE_DAY, carried on from an earlier one that was stored."""
    folder = shared_folder(t["positions"].sparkSession)
    first = carried.holding_state(t, FIRST_STATE).save(folder)
    return carried.advanced(t, first, STATE_DAY).save(folder)


def _carried_after_correction(t: Tables) -> DataFrame:
    """Days from a state in whose last week one fund's rows had not arrived, after they have."""
    late = F.expr(f"fund = 'quant' AND caldt > date_sub(DATE'{STATE_DAY}', 7) AND caldt <= DATE'{STATE_DAY}'")
    dated = ("positions", "trades", "dividends")
    early = {name: t[name].filter(~late) if name in dated else t[name] for name in t}
    state = carried.holding_state(early, STATE_DAY).save(shared_folder(t["positions"].sparkSession))
    state = carried.corrected(t, state, *[t[name].filter(late) for name in dated])
    return carried.holding_returns_from(t, state, LAST_DAY)


def _laid_out(t: Tables) -> laid_out.LaidOut:
    return laid_out.store_merged_days(t, shared_folder(t["positions"].sparkSession), BUCKETS, PERIOD)


def _laid_out_positions(t: Tables) -> laid_out.LaidOut:
    return laid_out.store_positions(t, shared_folder(t["positions"].sparkSession), 1, PERIOD)


def _stored(t: Tables) -> stored_statistics.StoredStatistics:
    return stored_statistics.store_statistics(t, shared_folder(t["delta_nav"].sparkSession))


def _six_places(df: DataFrame, name: str) -> DataFrame:
    """Sums of money, which are large, to six places; measures keep theirs."""
    return df.withColumn(name, F.expr(f"floor({name} * 1e6D + 0.5D) / 1e6D"))


def _upsert_portfolio(t: Tables) -> DataFrame:
    target = t["portfolio"]
    updates = target.sparkSession.createDataFrame(PORTFOLIO_BATCH, target.schema)
    return plans.upsert_portfolios(t, updates, len(PORTFOLIO_BATCH))


def _expected_return(t: Tables) -> DataFrame:
    return _fund_series(t).groupBy("fund").agg(
        stats.annualised_mean(F.col("xs_return")).alias("expected_return")
    )


def _volatility(t: Tables) -> DataFrame:
    return _fund_series(t).groupBy("fund").agg(
        stats.annualised_volatility(F.col("return")).alias("volatility")
    )


def _tracking_error(t: Tables) -> DataFrame:
    return _fund_and_benchmark(t).groupBy("fund").agg(
        stats.annualised_volatility(F.col("xs_return") - F.col("xs_div_return")).alias("tracking_error")
    )


def _ols(t: Tables) -> DataFrame:
    y, x = F.col("xs_return"), F.col("xs_return_bmk")
    return _fund_and_benchmark(t).groupBy("fund").agg(
        stats.ols_beta(y, x).alias("beta"), stats.ols_alpha(y, x).alias("alpha")
    )


def _lag_state(t: Tables) -> DataFrame:
    return operators.lag_state(_merge(t)).select(*LAG_COLUMNS)


def _cumulative_return(t: Tables) -> DataFrame:
    series = _fund_series(t).select("fund", "caldt", "return")
    return cumulative_return(series, "return", "total_return", ["fund"])


def _windowed(plan: Callable, *extra) -> Callable[[Tables], DataFrame]:
    return lambda t: plan(t, START, END, *extra)


def _measure(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: plans.fund_performance(t, START, END).select("fund", name)


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # Return series and look-ups
    "total_daily_returns": _windowed(plans.total_daily_returns),
    "fund_daily_returns": _windowed(plans.fund_daily_returns),
    "holding_daily_returns": _windowed(plans.holding_daily_returns),
    "all_holdings_daily_returns": _windowed(plans.all_holdings_daily_returns),
    "benchmark_daily_returns": _windowed(plans.benchmark_daily_returns),
    "traded_tickers": _windowed(plans.traded_tickers),
    "current_tickers": plans.current_tickers,
    "dividend_history": _windowed(plans.dividend_history),
    "trade_history": _windowed(plans.trade_history),
    "recent_logs": plans.recent_logs,
    "logs_by_fund": lambda t: plans.logs_by_fund(t, LOG_START, LOG_END, LOG_FUNDS),
    "portfolio_defaults": plans.portfolio_defaults,
    "upsert_portfolio": _upsert_portfolio,
    "current_holdings": plans.current_holdings,
    "upsert_holding": _upsert_holding,
    "ticker_universe": lambda t: plans.ticker_universe(t, UNIVERSE_DAY),
    # Performance, reports and cumulative series
    "total_performance": _windowed(plans.total_performance),
    "fund_performance": _windowed(plans.fund_performance),
    "performance_report": _windowed(plans.performance_report),
    "performance_report_formatted": _windowed(plans.performance_report_formatted),
    "holdings_performance": _windowed(plans.holdings_performance),
    "holdings_report_formatted": _windowed(plans.holdings_report_formatted),
    "total_return_series": _windowed(plans.total_return_series),
    "fund_return_series": _windowed(plans.fund_return_series),
    "combined_return_series": _windowed(plans.combined_return_series),
    # Stages, over the full history unless they need a window
    "dividends_by_day": lambda t: operators.dividends_by_day(t["dividends"]),
    "dividends_by_action": lambda t: dividends_by_action(t["dividends"]),
    "dividends_per_fund_day": lambda t: operators.dividends_per_fund_day(
        dividends_by_action(t["dividends"])
    ),
    "risk_free_fill": _risk_free_fill,
    "position_snapshot": lambda t: operators.position_snapshot(t["positions"]),
    "net_trades": lambda t: operators.net_trades(t["trades"]),
    "position_trade_merge": _merge,
    "lagged_position_state": lambda t: operators.lagged_position_state(_merge(t)),
    "position_values": _values,
    "position_returns": lambda t: operators.position_returns(_values(t), t["nav"]),
    "trading_day_filter": lambda t: operators.on_trading_days(t["delta_nav"], t["calendar"]),
    "latest_snapshot": lambda t: operators.latest_snapshot(t["positions"]),
    "benchmark_join": _benchmark_join,
    # Published versions, carried state, laid-out history and stored statistics
    "published_holding": lambda t: _published_targets(t).read(),
    "published_holding_changes": lambda t: _published_targets(t).changes(0),
    "published_portfolio": _published_portfolio,
    "carried_holding_state": lambda t: _carried_state(t).holdings,
    "carried_holding_returns": lambda t: carried.holding_returns_from(t, _carried_state(t), LAST_DAY),
    "carried_after_correction": _carried_after_correction,
    "laid_out_holding_returns": lambda t: laid_out.holding_returns_laid_out(t, _laid_out(t), START, END),
    "laid_out_latest_snapshot": lambda t: laid_out.latest_rows(_laid_out_positions(t)),
    "laid_out_holdings_performance": lambda t: laid_out.holdings_performance_laid_out(
        t, _laid_out(t), _laid_out_positions(t), START, END
    ),
    "stored_fund_performance": lambda t: _six_places(
        stored_statistics.stored_fund_performance(_stored(t), START, END), "dividends"
    ),
    "stored_total_performance": lambda t: _six_places(
        stored_statistics.stored_total_performance(_stored(t), CUT_START, CUT_END), "dividends"
    ),
    "stored_performance_report": lambda t: stored_statistics.stored_performance_report(_stored(t), CUT_START, CUT_END),
    # Long windows in pieces, exact sums, several regressors
    "sliced_lag_state": lambda t: operators.lag_state_sliced(_merge(t)).select(*LAG_COLUMNS),
    "scanned_total_return_series": _windowed(plans.total_return_series_scanned),
    "exact_dividends_by_day": lambda t: operators.dividends_by_day(t["dividends"], exact=True),
    "fund_factor_model": _windowed(plans.fund_factor_model),
    # Single measures
    "op_volatility": _volatility,
    "op_tracking_error": _tracking_error,
    "op_expected_return": _expected_return,
    "op_ols_beta_alpha": _ols,
    "op_sharpe_ratio": _measure("sharpe_ratio"),
    "op_information_ratio": _measure("information_ratio"),
    "op_period_alpha": _measure("alpha"),
    "op_cumulative_return": _cumulative_return,
    "op_lag_state": _lag_state,
}


# The queries that need nothing but the library.
LIBRARY = tuple(_QUERIES)

# Statistics are small numbers: more places of them are compared than the usual six.
PLACES = {"holdings_performance": 8, "laid_out_holdings_performance": 8, "fund_factor_model": 8} | dict.fromkeys(
    (
        "total_performance",
        "fund_performance",
        "performance_report",
        "stored_fund_performance",
        "stored_total_performance",
        "stored_performance_report",
        *(name for name in _QUERIES if name.startswith("op_") and name not in ("op_lag_state", "op_cumulative_return")),
    ),
    10,
)


def _bound(name: str, query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(query(demo_tables(spark, sf_dir)), PLACES.get(name, 6))


def _optional(module: str):
    """A module of the corpus part, or None where that part isn't installed; errors inside it surface."""
    spec = importlib.util.find_spec(module)
    return importlib.import_module(module) if spec is not None and spec.origin else None


def _corpus(attribute: str) -> dict:
    """Queries or SQL of the corpus operators and of the pipeline over them."""
    if _optional("fundperf.llm") is None:
        return {}
    found = dict(getattr(importlib.import_module("fundperf.llm.queries"), attribute))
    pipeline = _optional("corpus_pipeline")
    if pipeline is not None:
        if attribute == "QUERIES":
            found["pipeline"] = pipeline.run
        elif pipeline.ORACLE_SQL is not None:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Performance of every fund on the smallest test tables."""
    return queries()["fund_performance"](spark, ENTRY_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(name, query) for name, query in _QUERIES.items()} | _corpus("QUERIES")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | _corpus("ORACLES")
