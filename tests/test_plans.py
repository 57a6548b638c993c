"""Shapes of physical plans that must hold at any data size."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from fundperf import plans
from fundperf.functions.bounds import BROADCAST_ROW_LIMIT, broadcast_within, day_span
from fundperf.sources import parquet_tables
from tests.frames import make_tables

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(contract.LIBRARY))
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", ["all_holdings_daily_returns", "position_returns", "op_lag_state"])
def test_windows_over_holdings_are_partitioned(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    windows = re.findall(r"windowspecdefinition\(([^,]*), ([^,]*)", plan)
    assert windows
    assert all(a.startswith("fund#") and b.startswith("ticker#") for a, b in windows)
    assert "Exchange SinglePartition" not in plan


def test_holdings_need_two_shuffles_of_the_merged_rows(spark, no_automatic_broadcast):
    """Without automatic broadcasts the merge is shuffled for its aggregate and for its window only."""
    tables = make_tables(spark)
    plan = plan_of(plans.all_holdings_daily_returns(tables, "2024-01-01", "2024-12-31", ["grad"]))
    assert plan.count("hashpartitioning(fund#") - len(re.findall(r"hashpartitioning\(fund#\d+, ticker#\d+, action_id", plan)) == 1
    assert len(re.findall(r"hashpartitioning\(caldt#\d+, fund#\d+, ticker#\d+", plan)) == 1
    assert "FullOuter" not in plan


def test_daily_tables_are_broadcast_by_their_day_bound(spark, no_automatic_broadcast):
    tables = make_tables(spark)
    plan = plan_of(plans.all_holdings_daily_returns(tables, "2024-01-01", "2024-12-31", ["grad"]))
    assert plan.count("BroadcastHashJoin") == 3  # calendar, stock value, risk-free rate


def test_no_broadcast_beyond_the_bound(spark, no_automatic_broadcast):
    left, right = spark.range(10), spark.range(10)
    assert "BroadcastHashJoin" in plan_of(left.join(broadcast_within(right, BROADCAST_ROW_LIMIT), "id"))
    for bound in (None, BROADCAST_ROW_LIMIT + 1):
        assert "BroadcastHashJoin" not in plan_of(left.join(broadcast_within(right, bound), "id"))


def test_day_span():
    assert day_span("2024-01-01", "2024-12-31") == 366
    assert day_span("2024-01-02", "2024-01-01") == 0


def test_upsert_does_not_shuffle_the_target(spark, no_automatic_broadcast):
    tables = make_tables(spark, holding=[("grad", "A", "2024-06-01", 1.0)])
    plan = plan_of(plans.upsert_holding(tables, "grad", "A", "2024-07-01", 5.0))
    joins = re.findall(r"(\w+Join) \[[^\]]*\], \[[^\]]*\], (\w+)", plan)
    assert sorted(joins) == [
        ("BroadcastHashJoin", "LeftOuter"),
        ("BroadcastHashJoin", "LeftSemi"),
        ("SortMergeJoin", "LeftAnti"),  # the batch against its own matches
    ]


@pytest.mark.parametrize("history", ["dividend_history", "trade_history", "current_tickers"])
def test_conditions_on_sorted_results_reach_the_files(spark, tmp_path, history):
    table = {"dividend_history": "dividends", "trade_history": "trades", "current_tickers": "positions"}[history]
    rows = {
        "dividends": [("2024-01-02", "grad", "A", 1, 1.0, 2.0)],
        "trades": [("2024-01-02", "grad", "A", "EQ", "BUY", 1.0, 2.0)],
        "positions": [("2024-01-02", "grad", "A", "EQ", 1.0, 2.0, 1.0)],
    }
    make_tables(spark, **{table: rows[table]})[table].write.parquet(str(tmp_path / table))
    stored = parquet_tables(spark, str(tmp_path))
    window = () if history == "current_tickers" else ("2024-01-01", "2024-02-01")
    result = getattr(plans, history)(stored, *window).filter("fund = 'grad' AND ticker = 'A'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(result)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(fund,grad)" in plan and "EqualTo(ticker,A)" in plan
    assert result.count() == 1


def test_sold_holdings_are_left_out_before_the_merge(spark, no_automatic_broadcast):
    """Each base table meets the current tickers below the first aggregate."""
    tables = make_tables(spark)
    logical = plans.holdings_performance(tables, "2024-01-01", "2024-12-31", ["grad"])
    lines = logical._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    semi = [i for i, line in enumerate(lines) if "Join LeftSemi" in line and "ticker" in line]
    assert len(semi) == 3
    for i in semi:
        below = [lines[j] for j in range(i + 1, len(lines)) if all(depth[k] > depth[i] for k in range(i + 1, j + 1))]
        left = [line for line, d in zip(below, depth[i + 1 :]) if d > depth[i]]
        first_aggregate = next((k for k, line in enumerate(left) if "Aggregate" in line), None)
        first_scan = next(k for k, line in enumerate(left) if "LocalRelation" in line or "Relation [" in line or "RDD" in line)
        assert first_aggregate is None or first_scan < first_aggregate


def test_holdings_are_sorted_once_for_their_windows(spark, no_automatic_broadcast):
    plan = plan_of(plans.all_holdings_daily_returns(make_tables(spark), "2024-01-01", "2024-12-31", ["grad"]))
    assert len(re.findall(r"Sort \[fund#\d+ ASC NULLS FIRST, ticker#\d+ ASC NULLS FIRST", plan)) == 1


def test_a_report_of_a_few_rows_is_sorted_in_one_partition(spark):
    plan = plan_of(plans.performance_report(make_tables(spark), "2024-01-01", "2024-12-31"))
    assert "rangepartitioning" not in plan


def test_conditions_and_columns_reach_the_files(spark, tmp_path):
    tables = make_tables(spark, positions=[("2024-01-02", "grad", "A", "EQ", 1.0, 2.0, 1.0)])
    tables["positions"].write.parquet(str(tmp_path / "positions"))
    stored = parquet_tables(spark, str(tmp_path))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(plans.traded_tickers(stored, "2024-01-01", "2024-02-01", ["grad"]))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: (.*), ReadSchema: (.*)", plan)
    assert "EqualTo(fund,grad)" in pushed.group(1)
    assert "GreaterThanOrEqual(caldt,2024-01-01)" in pushed.group(1)
    assert "shares" not in pushed.group(2)


def test_day_folders_are_pruned(spark, tmp_path):
    rows = [(f"2024-01-{d:02d}", "grad", f"T{d}", "EQ", 1.0, 2.0, 1.0) for d in range(1, 10)]
    positions = make_tables(spark, positions=rows)["positions"]
    positions.write.partitionBy("caldt").parquet(str(tmp_path / "positions"))
    stored = parquet_tables(spark, str(tmp_path))
    universe = plans.ticker_universe(stored, "2024-01-05", ["grad"])
    assert sorted(map(tuple, universe.collect())) == [("all_tickers", "T5"), ("grad", "T5")]
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(universe))
    assert scans and all("caldt" in scan for scan in scans)
