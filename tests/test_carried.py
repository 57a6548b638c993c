"""Runs from a carried state against runs over the full history."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fundperf import plans
from fundperf.plans import carried
from fundperf.plans.returns import TablesLike
from fundperf.sources import parquet_tables
from tests.compare import first_difference, spark_rows
from tests.frames import day, make_tables, rows_of
from tests.test_holdings_brute_force import FIRST, random_tables

AS_OF, END = day("2024-01-13"), day("2024-01-28")


def whole(tables: TablesLike, start, end, **options):
    return spark_rows(plans.all_holdings_daily_returns(tables, start, end, **options))[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_days_after_a_state_equal_the_full_run(spark, tmp_path, seed):
    tables = make_tables(spark, **random_tables(seed))
    state = carried.holding_state(tables, AS_OF).save(str(tmp_path))
    expected = whole(tables, AS_OF + timedelta(days=1), END)
    got = spark_rows(carried.holding_returns_from(tables, state, END))[1]
    assert expected and first_difference(got, expected) is None
    later = AS_OF + timedelta(days=5)
    got = spark_rows(carried.holding_returns_from(tables, state, END, later, ["grad"], rf_fill="previous"))[1]
    assert first_difference(got, whole(tables, later, END, funds=["grad"], rf_fill="previous")) is None


@pytest.mark.parametrize("seed", [4, 5])
def test_a_state_carried_on_day_by_day_is_that_of_the_full_history(spark, tmp_path, seed):
    tables = make_tables(spark, **random_tables(seed))
    state = carried.holding_state(tables, FIRST)
    for step in (1, 4, 3, 4):
        state = carried.advanced(tables, state, state.as_of + timedelta(days=step)).save(str(tmp_path))
    assert state.as_of == AS_OF
    direct = carried.holding_state(tables, AS_OF)
    assert first_difference(spark_rows(state.holdings)[1], spark_rows(direct.holdings)[1]) is None
    assert first_difference(spark_rows(state.actions)[1], spark_rows(direct.actions)[1]) is None
    loaded = carried.HoldingState.load(spark, str(tmp_path), AS_OF)
    assert spark_rows(loaded.holdings) == spark_rows(state.holdings) and loaded.as_of == AS_OF


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_late_rows_correct_the_holdings_concerned(spark, tmp_path, seed):
    rows = random_tables(seed)
    tables = make_tables(spark, **rows)
    is_late = F.expr("caldt <= DATE'2024-01-13' AND caldt > DATE'2024-01-08' AND fund = 'grad'")
    dated = ("positions", "trades", "dividends")
    early = {name: tables[name].filter(~is_late) if name in dated else tables[name] for name in tables}
    state = carried.holding_state(early, AS_OF).save(str(tmp_path / "early"))
    expected = whole(tables, AS_OF + timedelta(days=1), END)
    late = [tables[name].filter(is_late) for name in dated]
    fixed = carried.corrected(tables, state, *late)
    got = spark_rows(carried.holding_returns_from(tables, fixed, END))[1]
    assert first_difference(got, expected) is None
    direct = carried.holding_state(tables, AS_OF)
    assert first_difference(spark_rows(fixed.holdings)[1], spark_rows(direct.holdings)[1]) is None
    assert first_difference(spark_rows(fixed.actions)[1], spark_rows(direct.actions)[1]) is None


def test_withdrawn_rows_take_their_holding_out_of_the_state(spark):
    kept = [("2024-01-02", "grad", "A", "EQ", 5.0, 10.0, 1.0)]
    withdrawn = [("2024-01-03", "grad", "B", "EQ", 5.0, 10.0, 1.0)]
    before, after = make_tables(spark, positions=kept + withdrawn), make_tables(spark, positions=kept)
    state = carried.holding_state(before, AS_OF)
    assert rows_of(state.holdings.select("ticker")) == [("A",), ("B",)]
    gone = make_tables(spark, positions=withdrawn)["positions"]
    assert rows_of(carried.corrected(after, state, positions=gone).holdings.select("ticker")) == [("A",)]
    assert rows_of(carried.corrected(after, state).holdings.select("ticker")) == [("A",), ("B",)]


def test_windows_must_follow_the_state(spark):
    tables = make_tables(spark, **random_tables(9))
    state = carried.holding_state(tables, AS_OF)
    with pytest.raises(ValueError, match="after the state"):
        carried.holding_returns_from(tables, state, END, AS_OF)
    with pytest.raises(ValueError, match="already"):
        carried.advanced(tables, state, AS_OF)


def test_a_run_from_a_state_reads_new_days_only(spark, tmp_path):
    """The date conditions reach the scans of positions, trades and dividends."""
    root = str(tmp_path / "tables")
    made = make_tables(spark, **random_tables(10))
    for name in made:
        made[name].write.parquet(f"{root}/{name}")
    tables = parquet_tables(spark, root)
    state = carried.holding_state(tables, AS_OF).save(str(tmp_path / "state"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = carried.holding_returns_from(tables, state, END)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for name in ("positions", "trades", "dividends"):
        scans = [line for line in plan.splitlines() if "FileScan" in line and f"/{name}]" in line]
        assert scans and all("GreaterThanOrEqual(caldt,2024-01-14)" in line for line in scans), name


def test_a_run_sums_the_actions_of_its_own_rows_only(spark, tmp_path):
    """The stored actions meet the new dividends, and for a correction its holdings, before they are summed."""
    rows = random_tables(11)
    # Keys that are null are keys of their own: an action without a number goes on after the state.
    rows["dividends"] += [(day("2024-01-12"), "grad", "A", None, 0.5, 2.0), (day("2024-01-15"), "grad", "A", None, 1.5, 4.0)]
    tables = make_tables(spark, **rows)
    late = F.expr("caldt <= DATE'2024-01-13' AND caldt > DATE'2024-01-08' AND fund = 'grad'")
    dated = ("positions", "trades", "dividends")
    early = {name: tables[name].filter(~late) if name in dated else tables[name] for name in tables}
    state = carried.holding_state(early, AS_OF).save(str(tmp_path))
    fixed = carried.corrected(tables, state, *[tables[name].filter(late) for name in dated])
    df = carried.holding_returns_from(tables, fixed, END)
    assert first_difference(spark_rows(df)[1], whole(tables, AS_OF + timedelta(days=1), END)) is None
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "<=> _action_id#" in plan
