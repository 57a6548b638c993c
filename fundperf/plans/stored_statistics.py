"""Performance measures of any window from stored monthly states.

Three tables are stored for each line, a fund or all funds together: its days next to the benchmark, by month; one
state per month over the days with a risk-free rate; and the days without a rate, of which there are few. A
window's measures come from the states of its whole months, from the days of the months it cuts, and from its days
without a rate, whose rate depends on the window: the first of them gets the window's latest rate, the others have
none. So a report over decades reads a row per month and line instead of the history behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundperf.constants import TOTAL_LABEL
from fundperf.functions.bounds import as_date, in_window
from fundperf.functions.moments import Compound, Moments, Pairs, merged_states
from fundperf.functions.stats import period_alpha, ratio
from fundperf.functions.text import titled
from fundperf.operators.risk_free import excess, risk_free_fill
from fundperf.operators.snapshots import for_funds, ordered_few
from fundperf.plans.performance import FUND_MEASURES, REPORT_MEASURES, TOTAL_MEASURES
from fundperf.plans.returns import TablesLike, benchmark_moves, fund_moves, total_moves
from fundperf.sources.storage import stored

#: Days of all tables lie between these.
EVER = (date(1600, 1, 1), date(9999, 12, 31))

RETURN, RESIDUAL, EXCESS = Moments("return"), Moments("residual"), Moments("excess")
GROWTH = Compound("line")
#: The benchmark's return without and with dividends, and the regressions on its excess returns.
BENCHMARK_GROWTH = {"price": Compound("price"), "dividends": Compound("paid")}
REGRESSION = {"price": Pairs("on_price"), "dividends": Pairs("on_paid")}
PARTS = [RETURN, RESIDUAL, EXCESS, GROWTH, *BENCHMARK_GROWTH.values(), *REGRESSION.values()]


@dataclass(frozen=True)
class StoredStatistics:
    """The stored tables: days by month, monthly states, days without a rate, and the benchmark's days."""

    days: DataFrame
    months: DataFrame
    unrated: DataFrame
    benchmark: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StoredStatistics:
        names = ("days", "months", "unrated", "benchmark")
        return cls(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names])


def _rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with the day's rate and whether it has one; a rate without a value fails the job."""
    given = rates.selectExpr(
        "caldt",
        "coalesce(return, raise_error('risk-free rate without a value')) AS rate",
        "true AS _rated",
    )
    return rows.join(given, "caldt", "left").selectExpr(
        *[f"`{name}`" for name in rows.columns], "rate", "coalesce(_rated, false) AS rated"
    )


def _with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("caldt", "yyyy-MM"))


def _states(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial states of rows with xs_return, benchmark returns and excess returns."""
    day, xs = F.col("caldt"), F.col("xs_return")
    return rows.groupBy(*keys).agg(
        *RETURN.partial(F.col("return")),
        *RESIDUAL.partial(xs - F.col("xs_div_return")),
        *EXCESS.partial(xs),
        *GROWTH.partial(F.col("return"), day),
        *BENCHMARK_GROWTH["price"].partial(F.col("return_bmk"), day),
        *BENCHMARK_GROWTH["dividends"].partial(F.col("div_return"), day),
        *REGRESSION["price"].partial(xs, F.col("xs_return_bmk")),
        *REGRESSION["dividends"].partial(xs, F.col("xs_div_return")),
        F.sum("dividends").alias("dividends"),
        F.max(F.when(F.col("rated"), F.struct("caldt", "rate"))).alias("latest"),
    )


def _beside(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of lines next to the benchmark's returns; those that count as zero where there are none are filled."""
    wanted = benchmark.select(
        "caldt",
        F.col("return").alias("return_bmk"),
        "div_return",
        F.col("xs_return").alias("xs_return_bmk"),
        "xs_div_return",
    )
    joined = rows.join(wanted, "caldt", "left")
    return joined.fillna(0.0, ["div_return", "xs_return_bmk", "xs_div_return"])


def store_statistics(tables: TablesLike, path: str) -> StoredStatistics:
    """All tables of the history, written below a new folder."""
    root = path.rstrip("/")
    rates = tables["risk_free_rate"]
    benchmark = stored(
        _rated(benchmark_moves(tables, *EVER).select("caldt", "action_id", "return", "div_return"), rates), f"{root}/benchmark"
    )
    total = total_moves(tables, *EVER).withColumn("fund", F.lit(TOTAL_LABEL))
    columns = ["caldt", "fund", "return", "dividends"]
    lines = _rated(fund_moves(tables, *EVER).select(*columns).unionByName(total.select(*columns)), rates)
    settled = benchmark.withColumnsRenamed({"rate": "rf_return"})
    days = _beside(
        lines.withColumn("xs_return", F.col("return") - F.col("rate")), excess(settled, "return", "div_return")
    )
    written = stored(_with_month(days), f"{root}/days", "month")
    months = stored(_states(written.filter("rated"), ["fund", "month"]), f"{root}/months")
    unrated = stored(lines.filter("NOT rated").select(*columns), f"{root}/unrated")
    return StoredStatistics(written, months, unrated, benchmark)


def _whole_months(start: date, end: date) -> tuple[date, date]:
    """First and last day of the whole months in a window; the first day is after the last one if there are none."""
    first = start if start.day == 1 else (start.replace(day=28) + timedelta(days=4)).replace(day=1)
    after = end + timedelta(days=1)
    return first, after.replace(day=1) - timedelta(days=1)


def window_states(
    store: StoredStatistics, start: str | date, end: str | date, lines: Sequence[str] | None = None
) -> DataFrame:
    """One state per line over a window, its days without a rate included."""
    start, end = as_date(start), as_date(end)
    first, last = _whole_months(start, end)
    if first <= last:
        month = F.col("month").between(first.strftime("%Y-%m"), last.strftime("%Y-%m"))
        cut = (F.col("caldt") < F.lit(first)) | (F.col("caldt") > F.lit(last))
    else:
        month, cut = F.lit(False), F.lit(True)
    touched = {d.strftime("%Y-%m") for d in (start, end)}
    # Only the months that the window cuts are read by day.
    partial = for_funds(store.days, lines).filter(F.col("month").isin(*touched) & in_window(start, end) & cut & F.col("rated"))
    rated = for_funds(store.months, lines).filter(month).drop("month").unionByName(_states(partial, ["fund"]))
    # Days without a rate: the first one takes the line's latest rate of the window.
    latest = rated.groupBy("fund").agg(F.max("latest").alias("latest"))
    days = for_funds(store.unrated, lines).filter(in_window(start, end))
    first_day = days.groupBy("fund").agg(F.min("caldt").alias("_first"))
    filled = (
        days.join(first_day, "fund")
        .join(latest, "fund", "left")
        .withColumn("xs_return", F.when(F.col("caldt") == F.col("_first"), F.col("return") - F.col("latest.rate")))
        .withColumn("rated", F.lit(False))
        .withColumn("rate", F.lit(None).cast("double"))
    )
    known = store.benchmark.filter(in_window(start, end))
    rates = known.filter("rated").select("caldt", F.col("rate").alias("return")).distinct()
    moves = risk_free_fill(known.drop("rate", "rated"), rates, start, end, tie_break=["action_id"])
    # The fill looks at all days of the benchmark; only those without a rate go on.
    missing = excess(moves, "return", "div_return").join(rates.select("caldt"), "caldt", "left_anti")
    unrated = _states(_beside(filled, missing), ["fund"])
    parts = rated.unionByName(unrated)
    return merged_states(parts, ["fund"], PARTS, F.sum("dividends").alias("dividends"))


def _measures(states: DataFrame, alpha: str, benchmark: str) -> DataFrame:
    pairs, growth = REGRESSION[benchmark], BENCHMARK_GROWTH[benchmark]
    stats = states.select(
        "fund",
        "dividends",
        GROWTH.total().alias("total_return"),
        growth.total().alias("total_return_bmk"),
        RETURN.volatility().alias("volatility"),
        pairs.beta().alias("beta"),
        pairs.alpha().alias("daily_alpha"),
        RESIDUAL.volatility().alias("tracking_error"),
        EXCESS.annual_mean().alias("expected_return"),
    )
    whole = F.col("daily_alpha") if alpha == "intercept" else period_alpha(
        F.col("total_return"), F.col("total_return_bmk"), F.col("beta")
    )
    return stats.withColumn("alpha", whole).withColumns(
        {
            "sharpe_ratio": ratio(F.col("expected_return"), F.col("volatility")),
            "information_ratio": ratio(F.col("alpha"), F.col("tracking_error")),
        }
    )


def stored_fund_performance(
    store: StoredStatistics, start: str | date, end: str | date, funds: Sequence[str] | None = None
) -> DataFrame:
    """The lines of ``fund_performance`` for a window, from stored states."""
    lines = window_states(store, start, end, funds).filter(F.col("fund") != TOTAL_LABEL)
    return _measures(lines, "period", "price").select("fund", *FUND_MEASURES)


def stored_total_performance(store: StoredStatistics, start: str | date, end: str | date) -> DataFrame:
    """The line of ``total_performance`` for a window, from stored states."""
    line = window_states(store, start, end, [TOTAL_LABEL])
    return _measures(line, "intercept", "dividends").select(*TOTAL_MEASURES)


def stored_performance_report(store: StoredStatistics, start: str | date, end: str | date) -> DataFrame:
    """``performance_report`` for a window, from stored states."""
    states = window_states(store, start, end)
    total = _measures(states.filter(F.col("fund") == TOTAL_LABEL), "intercept", "dividends")
    lines = _measures(states.filter(F.col("fund") != TOTAL_LABEL), "period", "price")
    report = lines.unionByName(total).select(titled(F.col("fund")).alias("fund"), *REPORT_MEASURES)
    return ordered_few(report, "fund")
