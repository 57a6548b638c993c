"""Windows in pieces against windows in one."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fundperf import operators, plans
from fundperf.operators.dividends import dividends_by_action
from tests.compare import first_difference, spark_rows
from tests.frames import make_tables, rows_of
from tests.test_holdings_brute_force import END, START, random_tables


def merged_of(tables):
    return operators.position_trade_merge(tables["positions"], tables["trades"], dividends_by_action(tables["dividends"]))


@pytest.mark.parametrize("unit", ["year", "month", "week"])
def test_sliced_lags_equal_whole_ones(spark, unit):
    for seed in (31, 32):
        merged = merged_of(make_tables(spark, **random_tables(seed)))
        assert first_difference(
            spark_rows(operators.lag_state_sliced(merged, unit))[1], spark_rows(operators.lag_state(merged))[1]
        ) is None


def hot_rows(n=3000):
    rng = random.Random(33)
    first = date(2000, 1, 3)
    hot = [(first + timedelta(days=i), "grad", "HOT", "EQ", float(rng.randrange(-5, 9)), 10.0 + i % 7, 1.0) for i in range(n)]
    other = [(first + timedelta(days=rng.randrange(n)), "quant", f"T{i % 40}", "EQ", 3.0, 5.0 + i % 3, 1.0) for i in range(n)]
    return hot + other


def test_a_holding_of_half_the_rows_is_cut_into_slices(spark):
    tables = make_tables(spark, positions=hot_rows())
    merged = merged_of(tables)
    sliced = operators.lag_state_sliced(merged)
    assert first_difference(spark_rows(sliced)[1], spark_rows(operators.lag_state(merged))[1]) is None
    most = merged.groupBy("fund", "ticker", F.trunc("caldt", "year")).count().agg(F.max("count")).first()[0]
    assert most <= 366 < merged.groupBy("fund", "ticker").count().agg(F.max("count")).first()[0]
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "previous_side" in line]
    assert windows and all(re.search(r"windowspecdefinition\(fund#\d+, ticker#\d+, _slice#\d+", line) for line in windows)
    assert "SinglePartition" not in plan


def test_previous_values_over_ranges(spark):
    rng = random.Random(34)
    days = sorted(rng.sample(range(2000), 300))
    rows = [(date(2000, 1, 1) + timedelta(days=d), None if i % 9 == 4 else float(i)) for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "caldt date, v double").repartition(5)
    expected = [(day, v, rows[i - 1][1] if i else None) for i, (day, v) in enumerate(rows)]
    for pieces in (1, 2, 7, 400):
        got = operators.previous_value(frame, "v", "before", pieces=pieces)
        assert sorted(tuple(r) for r in got.select("caldt", "v", "before").collect()) == expected
    assert operators.previous_value(frame.limit(0), "v", "before").collect() == []


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_running_returns_over_ranges(spark, pieces):
    rows = [(date(2000, 1, 1) + timedelta(days=i), None if i % 5 == 2 else (i % 7 - 3) / 100, i % 2) for i in range(90)]
    frame = spark.createDataFrame(rows, "caldt date, r double, k int").repartition(4)
    expected, growth = {}, 1.0
    for day, r, _ in rows:
        growth *= 1 + (r or 0.0)
        expected[day] = None if r is None else growth - 1
    for span in (None, (rows[0][0], rows[-1][0]), (date(1999, 1, 1), date(2000, 2, 1))):
        got = operators.running_returns(frame, {"total": F.col("r")}, ("caldt", "k"), pieces, span).collect()
        for row in got:
            want = expected[row["caldt"]]
            assert row["total"] is None if want is None else abs(row["total"] - want) < 1e-12
        assert len(got) == len(rows)


def test_the_scanned_series_equals_the_whole_one(spark):
    rows = random_tables(35)
    rows["delta_nav"] = [(START + timedelta(days=i), f, 100.0, 100.0 + (i * 7 + len(f)) % 5 - 2, 0.0) for i in range(18) for f in ("grad", "quant")]
    rows["benchmark"] = [(START + timedelta(days=i - 3), 50.0 + i * i % 7) for i in range(20) if i % 6]
    rows["dividends"] += [(START + timedelta(days=d), "undergrad", "IWV", d * 10 + i, 0.5, 1.0) for d in (2, 5) for i in range(2)]
    tables = make_tables(spark, **rows)
    for pieces in (1, 4):
        got = rows_of(plans.total_return_series_scanned(tables, START, END, pieces), "caldt", "cumulative_return", "cumulative_return_bmk")
        expected = rows_of(plans.total_return_series(tables, START, END), "caldt", "cumulative_return", "cumulative_return_bmk")
        assert len(got) == len(expected) >= 15
        for a, b in zip(got, expected):
            assert a[0] == b[0] and all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))


def test_only_a_row_per_piece_goes_through_one_task(spark):
    plan = plans.total_return_series_scanned(make_tables(spark), START, END)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            behind = " ".join(lines[i + 1 : i + 3])
            assert re.search(r"Aggregate\(keys?=\[_piece#", behind)
