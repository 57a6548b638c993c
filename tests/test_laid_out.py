"""Laid-out tables: the same results, without the shuffles before the window."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fundperf import operators, plans
from fundperf.plans import laid_out
from fundperf.sources import open_laid_out, shared_folder, write_laid_out
from tests.compare import first_difference, spark_rows
from tests.frames import make_tables, rows_of
from tests.test_holdings_brute_force import END, START, random_tables


@pytest.fixture(scope="module")
def random_layout(spark):
    tables = make_tables(spark, **random_tables(21))
    root = shared_folder(spark)
    return tables, laid_out.store_merged_days(tables, f"{root}/merged", 3), laid_out.store_positions(tables, f"{root}/positions", 2), root


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_holding_returns_from_the_layout(spark, random_layout):
    tables, merged, positions, _ = random_layout
    for options in ({}, {"funds": ["grad"]}, {"rf_fill": "previous"}):
        got = spark_rows(laid_out.holding_returns_laid_out(tables, merged, START, END, **options))[1]
        expected = spark_rows(plans.all_holdings_daily_returns(tables, START, END, **options))[1]
        assert expected and first_difference(got, expected) is None
    got = spark_rows(laid_out.holdings_performance_laid_out(tables, merged, positions, START, END))[1]
    assert first_difference(got, spark_rows(plans.holdings_performance(tables, START, END, None))[1]) is None


def test_no_shuffle_of_holdings_before_or_after_the_window(random_layout):
    """With named funds the stock values are broadcast; all else that is joined has one row a day."""
    tables, merged, _, _ = random_layout
    plan = plan_of(laid_out.holding_returns_laid_out(tables, merged, START, END, ["grad", "quant"]))
    assert not re.findall(r"hashpartitioning\(fund#\d+, ticker#\d+", plan)
    assert plan.count("Exchange hashpartitioning(caldt#") == plan.count("- Exchange")  # tables of one row a day or fund and day
    assert "Bucketed: true" in plan and "SinglePartition" not in plan
    direct = plan_of(plans.all_holdings_daily_returns(tables, START, END, ["grad", "quant"]))
    assert re.findall(r"hashpartitioning\(fund#\d+, ticker#\d+", direct)


def test_the_last_day_is_found_without_opening_the_rows(random_layout):
    tables, _, positions, root = random_layout
    got = spark_rows(laid_out.latest_rows(positions))[1]
    assert got and first_difference(got, spark_rows(operators.latest_snapshot(tables["positions"]))[1]) is None
    assert first_difference(
        spark_rows(laid_out.latest_rows(positions, ["quant"]))[1],
        spark_rows(operators.latest_snapshot(tables["positions"], ["quant"]))[1],
    ) is None
    days = plan_of(positions.last_days())
    assert "ReadSchema: struct<fund:string,caldt:date>" in days and "layout_" not in days
    assert re.search(r"PartitionFilters: \[[^\]]*period#\d+ (IN|=)", plan_of(laid_out.latest_rows(positions)))


def test_periods_after_the_window_are_not_opened(random_layout):
    tables, merged, _, _ = random_layout
    plan = plan_of(laid_out.holding_returns_laid_out(tables, merged, START, END))
    assert re.search(r"PartitionFilters: \[[^\]]*period#\d+ <= 2024-01", plan)


def test_appended_days_and_another_session(spark, tmp_path):
    rows = random_tables(22)
    cut = START + (END - START) / 2
    early = {name: [r for r in data if r[0] <= cut] for name, data in rows.items() if name in ("positions", "trades", "dividends")}
    # A late row of an action would change rows that are stored already; here actions start once.
    rows["dividends"] = [r for i, r in enumerate(rows["dividends"]) if (r[1], r[2], r[3]) not in {(q[1], q[2], q[3]) for q in rows["dividends"][:i]}]
    early["dividends"] = [r for r in rows["dividends"] if r[0] <= cut]
    tables = make_tables(spark, **rows)
    path = str(tmp_path / "merged")
    laid_out.store_merged_days(make_tables(spark, **(rows | early)), path, 4, "year")
    laid_out.append_merged_days(tables, path, cut, END)
    spark.sql(f"DROP TABLE layout_{__import__('hashlib').md5(path.encode()).hexdigest()}")
    merged = open_laid_out(spark, path)
    assert merged.period == "year" and merged.buckets == 4
    expected = spark_rows(plans.all_holdings_daily_returns(tables, START, END))[1]
    got = laid_out.holding_returns_laid_out(tables, merged, START, END)
    assert first_difference(spark_rows(got)[1], expected) is None
    assert "Bucketed: true" in plan_of(got)
    assert merged.days.agg(F.sum("rows")).first()[0] == merged.rows.count()


def test_a_layout_is_not_written_twice(spark, tmp_path):
    rows = make_tables(spark, positions=[("2024-01-02", "grad", "A", "EQ", 1.0, 2.0, 1.0)])["positions"]
    write_laid_out(rows, str(tmp_path / "t"), 2)
    with pytest.raises(ValueError, match="already"):
        write_laid_out(rows, str(tmp_path / "t"), 2)
    with pytest.raises(ValueError, match="unknown period"):
        write_laid_out(rows, str(tmp_path / "u"), 2, period="week")
    assert rows_of(open_laid_out(spark, str(tmp_path / "t")).rows.select("ticker", "period")) == [("A", "2024-01")]


def test_a_period_is_written_by_as_many_tasks_as_its_rows_ask_for(spark, tmp_path):
    """One file per period was one task that sorted all rows of a year."""
    days = [f"2024-01-{1 + i % 28:02d}" for i in range(6000)]
    booked = [(d, "grad", f"T{i}", "EQ", 1.0 + i, 2.0 * i, 1.0) for i, d in enumerate(days)]
    tables = make_tables(spark, positions=booked)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        written = laid_out.store_positions(tables, str(tmp_path / "many"), 1, "year")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(written.rows.inputFiles()) > 1
    assert rows_of(written.rows.drop("period")) == rows_of(tables["positions"])
    few = laid_out.store_positions(tables, str(tmp_path / "few"), 1, "year")
    assert len(few.rows.inputFiles()) == 1


def test_many_rows_get_more_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("fundperf.sources.layout.BUCKET_ROWS", 20, raising=False)
    tables = make_tables(spark, **random_tables(23))
    rows = tables["positions"].count() + tables["trades"].count()
    merged = laid_out.store_merged_days(tables, str(tmp_path / "merged"), 2)
    assert merged.buckets == -(-rows // 20) > 2
    got = laid_out.holding_returns_laid_out(tables, merged, START, END)
    assert first_difference(spark_rows(got)[1], spark_rows(plans.all_holdings_daily_returns(tables, START, END))[1]) is None
