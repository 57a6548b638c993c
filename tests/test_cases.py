"""Cases the test tables do not contain, on hand-made rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fundperf import operators, plans
from fundperf.functions import as_number, as_percent, titled
from fundperf.operators.dividends import dividends_by_action
from tests.frames import day, make_tables, rows_of

START, END = "2024-01-01", "2024-01-31"


def delta(*values, fund="grad"):
    """Days from 2024-01-02 on with (start, end) values and no flows."""
    return [(f"2024-01-{i:02d}", fund, float(a), float(b), 0.0) for i, (a, b) in enumerate(values, start=2)]


def test_zero_start_and_flat_days_vanish(spark):
    tables = make_tables(spark, delta_nav=delta((0, 5), (100, 100), (100, 110)))
    rows = rows_of(plans.fund_daily_returns(tables, START, END), "caldt", "return")
    assert len(rows) == 1
    assert rows[0][0] == day("2024-01-04") and math.isclose(rows[0][1], 0.1)
    assert plans.total_daily_returns(tables, START, END).count() == 1


def test_flows_count_for_the_fund_only(spark):
    tables = make_tables(spark, delta_nav=[("2024-01-02", "grad", 100.0, 120.0, 10.0)])
    fund = plans.fund_daily_returns(tables, START, END).first()
    total = plans.total_daily_returns(tables, START, END).first()
    assert fund["ending_value"] == 110.0 and math.isclose(fund["return"], 0.1)
    assert total["ending_value"] == 120.0 and math.isclose(total["return"], 0.2)


def test_two_dividend_rules_differ(spark):
    dividends = [
        ("2024-01-02", "grad", "A", 1, 0.5, 10.0),
        ("2024-01-02", "grad", "A", 2, 0.5, 20.0),
        ("2024-01-03", "grad", "A", 1, 0.5, 30.0),
    ]
    tables = make_tables(spark, dividends=dividends)
    by_day = rows_of(operators.dividends_by_day(tables["dividends"]))
    assert by_day == [(day("2024-01-02"), 15.0), (day("2024-01-03"), 30.0)]
    by_fund = operators.dividends_per_fund_day(dividends_by_action(tables["dividends"]))
    assert rows_of(by_fund) == [(day("2024-01-02"), "grad", 40.0)]


def test_first_missing_rate_takes_the_latest_known_one(spark):
    rates = [("2024-01-02", 0.01), ("2024-01-04", 0.02), ("2024-01-06", 0.03)]
    nav = delta((100, 101), (100, 102), (100, 103), (100, 104), (100, 105))
    tables = make_tables(spark, delta_nav=nav, risk_free_rate=rates)
    found = [r[1] for r in rows_of(plans.fund_daily_returns(tables, START, END), "caldt", "rf_return")]
    assert found == [0.01, 0.03, 0.02, None, 0.03]
    carried = plans.fund_daily_returns(tables, START, END, rf_fill="previous")
    assert [r[1] for r in rows_of(carried, "caldt", "rf_return")] == [0.01, 0.01, 0.02, 0.02, 0.03]


def test_rates_do_not_leak_between_funds(spark):
    nav = delta((100, 101), (100, 102)) + delta((100, 103), fund="quant")
    tables = make_tables(spark, delta_nav=nav, risk_free_rate=[("2024-01-03", 0.02)])
    found = rows_of(plans.fund_daily_returns(tables, START, END), "fund", "caldt", "rf_return")
    assert [r[2] for r in found] == [0.02, 0.02, None]


def test_duplicate_rate_fails_the_job(spark):
    tables = make_tables(
        spark, delta_nav=delta((100, 101)), risk_free_rate=[("2024-01-02", 0.01), ("2024-01-02", 0.02)]
    )
    with pytest.raises(Exception, match="more than one row per"):
        plans.fund_daily_returns(tables, START, END).collect()


@pytest.mark.parametrize("copies", ["nav", "delta_nav"])
def test_a_day_given_twice_fails_the_job(spark, copies):
    # One of the days is the last position day: an empty result may be found before the day is looked at.
    last = max(row[0] for row in POSITIONS)
    rows = {
        "nav": [(day, "grad", 9.0) for day in sorted({"2024-01-10", last})],
        "delta_nav": delta((100, 101)),
        "positions": POSITIONS,
        "calendar": [(f"2024-01-{d:02d}",) for d in range(1, 31)],
    }
    rows[copies] = rows[copies] * 2
    tables = make_tables(spark, **rows)
    jobs = {
        "nav": [plans.all_holdings_daily_returns(tables, START, END), plans.current_holdings(tables)],
        "delta_nav": [plans.fund_daily_returns(tables, START, END), plans.total_daily_returns(tables, START, END)],
    }
    for job in jobs[copies]:
        with pytest.raises(Exception, match="more than one row per"):
            job.collect()


def test_fill_alpha_and_benchmark_are_choices(spark):
    rates = [("2024-01-02", 0.01), ("2024-01-04", 0.02), ("2024-01-06", 0.03)]
    nav = delta((100, 101), (100, 102), (100, 103), (100, 104), (100, 106))
    dividends = [("2024-01-03", "undergrad", "IWV", 7, 1.0, 0.0)]
    tables = make_tables(spark, delta_nav=nav, risk_free_rate=rates, benchmark=benchmark_rows(100, 101, 104, 103, 107, 109), dividends=dividends)
    default = plans.fund_performance(tables, START, END).first()
    assert plans.fund_performance(tables, START, END, rf_fill="previous").first()["sharpe_ratio"] != default["sharpe_ratio"]
    daily = plans.fund_performance(tables, START, END, alpha="intercept").first()
    assert daily["alpha"] != default["alpha"] and math.isclose(daily["beta"], default["beta"])
    paid = plans.fund_performance(tables, START, END, benchmark="dividends").first()
    assert paid["total_return_bmk"] > default["total_return_bmk"]
    total = plans.total_performance(tables, START, END, alpha="period", benchmark="price").first()
    assert total["alpha"] != plans.total_performance(tables, START, END).first()["alpha"]
    for wrong in ({"alpha": "x"}, {"benchmark": "x"}):
        with pytest.raises(ValueError):
            plans.fund_performance(tables, START, END, **wrong)


def test_upsert_with_and_without_a_bound_agree(spark):
    tables = make_tables(spark, holding=HOLDING)
    batch = spark.createDataFrame(
        [("grad", "A", day("2024-07-01"), None), ("new", "Z", day("2024-08-01"), 3.0)], tables["holding"].schema
    )
    assert rows_of(plans.upsert_holdings(tables, batch)) == rows_of(plans.upsert_holdings(tables, batch, 2))


def test_unknown_fill_is_refused(spark):
    tables = make_tables(spark, delta_nav=delta((100, 101)))
    with pytest.raises(ValueError):
        plans.fund_daily_returns(tables, START, END, rf_fill="linear")


def benchmark_rows(*levels, start=1):
    return [(f"2024-01-{i:02d}", float(level)) for i, level in enumerate(levels, start=start)]


def test_benchmark_looks_back_before_the_window(spark):
    tables = make_tables(spark, benchmark=benchmark_rows(100, 110, 110, 121))
    rows = rows_of(plans.benchmark_daily_returns(tables, "2024-01-02", END), "caldt", "starting_value", "return")
    assert [r[0].day for r in rows] == [2, 4]
    assert rows[0][1] == 100.0 and math.isclose(rows[0][2], 0.1)
    first = rows_of(plans.benchmark_daily_returns(tables, "2024-01-01", END), "caldt")
    assert [r[0].day for r in first] == [2, 4]


def test_benchmark_dividends_of_one_day_multiply_its_row(spark):
    dividends = [("2024-01-02", "undergrad", "IWV", action, 1.0, 0.0) for action in (7, 8)]
    dividends.append(("2024-01-03", "undergrad", "IWV", 8, 3.0, 0.0))
    tables = make_tables(spark, benchmark=benchmark_rows(100, 110), dividends=dividends)
    rows = rows_of(plans.benchmark_daily_returns(tables, START, END), "dividends", "div_return")
    assert [round(r[1], 9) for r in rows] == [0.11, 0.12]


def performance(spark, **rows):
    return plans.fund_performance(make_tables(spark, **rows), START, END).first()


def test_benchmark_total_is_null_without_a_last_day(spark):
    nav = delta((100, 101), (100, 102), (100, 103))
    levels = benchmark_rows(100, 101, 102)
    row = performance(spark, delta_nav=nav, benchmark=levels, risk_free_rate=[])
    assert row["total_return_bmk"] is None and row["alpha"] is None
    assert math.isclose(row["total_return"], 1.01 * 1.02 * 1.03 - 1)
    whole = performance(spark, delta_nav=nav, benchmark=levels + [("2024-01-04", 103.0)])
    assert math.isclose(whole["total_return_bmk"], 0.03)


def test_gap_inside_the_period_is_skipped(spark):
    nav = delta((100, 101), (100, 102), (100, 103))
    levels = [("2024-01-01", 100.0), ("2024-01-02", 110.0), ("2024-01-04", 121.0)]
    row = performance(spark, delta_nav=nav, benchmark=levels)
    assert math.isclose(row["total_return_bmk"], 0.21)


def test_total_report_counts_a_missing_benchmark_day_as_zero(spark):
    nav = delta((100, 101), (100, 102), (100, 103))
    tables = make_tables(spark, delta_nav=nav, benchmark=benchmark_rows(100, 110))
    last = rows_of(plans.total_return_series(tables, START, END))[-1]
    assert math.isclose(last[2], 10.0)


def test_one_day_has_no_volatility(spark):
    row = performance(spark, delta_nav=delta((100, 101)))
    assert row["volatility"] is None and row["sharpe_ratio"] is None
    assert math.isclose(row["total_return"], 0.01)


def test_constant_regressor_has_no_beta(spark):
    nav = delta((100, 101), (100, 102), (100, 104))
    rates = [(f"2024-01-{i:02d}", 0.0) for i in range(1, 6)]
    row = performance(spark, delta_nav=nav, risk_free_rate=rates)
    assert row["beta"] is None and row["alpha"] is None
    assert row["total_return"] is not None


def test_returns_below_minus_one_compound(spark):
    nav = delta((100, -50), (100, 110))
    row = performance(spark, delta_nav=nav)
    assert math.isclose(row["total_return"], -0.5 * 1.1 - 1)


def test_empty_window(spark):
    tables = make_tables(spark, delta_nav=delta((100, 101)))
    assert plans.fund_performance(tables, "2023-01-01", "2023-02-01").count() == 0
    row = plans.total_performance(tables, "2023-01-01", "2023-02-01").first()
    assert row["total_return"] is None
    assert plans.fund_daily_returns(tables, "2024-02-01", "2024-01-01").count() == 0


POSITIONS = [
    ("2024-01-09", "grad", "A", "EQ", 5.0, 10.0, 1.0),
    ("2024-01-10", "grad", "A", "EQ", 5.0, 10.0, 1.0),
    ("2024-01-10", "grad", "A", "EQ", 7.0, 10.0, 1.0),
    ("2024-01-10", "grad", "C", "CASH", 1.0, 1.0, 1.0),
    ("2024-01-12", "grad", "O", "OPT", 1.0, 1.0, 1.0),
    ("2024-01-08", "quant", "B", "EQ", 2.0, 3.0, 1.0),
    ("2024-01-08", "quant", "N", None, 2.0, 3.0, 1.0),
]


@pytest.mark.parametrize("funds", [None, ["grad", "quant"]])
def test_last_day_counts_all_asset_classes(spark, funds):
    tables = make_tables(spark, positions=POSITIONS)
    # The last day of grad holds an option only, so it has no current ticker.
    assert rows_of(plans.current_tickers(tables, funds)) == [("quant", "B")]
    latest = rows_of(operators.latest_snapshot(tables["positions"], funds), "fund", "ticker")
    assert latest == [("grad", "O"), ("quant", "B"), ("quant", "N")]


def test_current_tickers_keep_duplicates(spark):
    tables = make_tables(spark, positions=POSITIONS[:4])
    assert rows_of(plans.current_tickers(tables)) == [("grad", "A"), ("grad", "A")]
    assert rows_of(plans.current_tickers(tables, ["nobody"])) == []


def test_current_holdings(spark):
    tables = make_tables(
        spark,
        positions=POSITIONS,
        nav=[("2024-01-08", "quant", 0.0), ("2024-01-12", "grad", 4.0), ("2024-01-10", "grad", 9.0)],
        holding=[("quant", "B", "2025-01-01", 9.5), ("quant", "Z", "2025-01-01", 1.0)],
    )
    rows = rows_of(plans.current_holdings(tables), "fund", "ticker", "value", "target_price", "weight")
    assert rows == [("grad", "O", 1.0, None, 0.25), ("quant", "B", 6.0, 9.5, None), ("quant", "N", 6.0, None, None)]


def test_ticker_universe(spark):
    tables = make_tables(spark, positions=POSITIONS + [("2024-01-10", "other", "X", "EQ", 1.0, 1.0, 1.0)])
    rows = rows_of(plans.ticker_universe(tables, "2024-01-10"))
    assert rows == [
        ("all_tickers", "A"), ("all_tickers", "C"), ("all_tickers", "X"),
        ("brigham_capital", None), ("grad", "A"), ("grad", "A"), ("grad", "C"),
        ("quant", None), ("undergrad", None),
    ]


def test_logs(spark):
    logs = [(f"2024-01-{d:02d}", f) for d in (1, 2, 2, 3, 4, 5, 6) for f in ("grad", "quant")]
    tables = make_tables(spark, logs=logs)
    recent = [row["caldt"].day for row in plans.recent_logs(tables).collect()]
    assert recent == [6, 6, 5, 5, 4, 4, 3, 3, 2, 2, 2, 2]
    assert plans.logs_by_fund(tables, "2024-01-02", "2024-01-03", ["grad"]).count() == 3
    assert plans.logs_by_fund(tables, "2024-01-02", "2024-01-03", ["grad", "quant"]).count() == 6
    assert plans.logs_by_fund(tables, "2024-01-02", "2024-01-03", []).count() == 0


def test_trade_value_is_total_shares_times_average_price(spark):
    trades = [("2024-01-02", "grad", "A", "EQ", "BUY", 1.0, 10.0), ("2024-01-02", "grad", "A", "EQ", "BUY", 3.0, 20.0)]
    row = plans.trade_history(make_tables(spark, trades=trades), START, END, "grad", "A").first()
    assert (row["shares"], row["price"], row["value"], row["side"]) == (4.0, 15.0, 60.0, "BUY")


def test_dividend_history_filters_before_grouping(spark):
    dividends = [("2024-01-02", "grad", "A", 1, 1.0, 10.0), ("2024-01-05", "grad", "A", 1, 3.0, 30.0)]
    tables = make_tables(spark, dividends=dividends)
    late = plans.dividend_history(tables, "2024-01-03", END, "grad", "A").first()
    assert (late["caldt"], late["gross_rate"], late["gross_amount"]) == (day("2024-01-05"), 3.0, 30.0)
    assert plans.dividend_history(tables, START, END, "grad", "A").first()["gross_rate"] == 2.0


def test_sorted_results_are_in_order(spark):
    days = [d for d in (9, 3, 7, 3, 1) for _ in range(40)]
    trades = [(f"2024-01-{d:02d}", "grad", f"T{i}", "EQ", "BUY", 1.0, 1.0) for i, d in enumerate(days)]
    found = [r["caldt"].day for r in plans.trade_history(make_tables(spark, trades=trades), START, END).collect()]
    assert found == sorted(days)


HOLDING = [("grad", "A", "2024-06-01", 1.0), ("grad", "B", "2024-06-01", 2.0)]


def test_upsert_updates_inserts_and_overwrites_with_null(spark):
    tables = make_tables(spark, holding=HOLDING)
    assert rows_of(plans.upsert_holding(tables, "grad", "A", "2024-07-01", None)) == [
        ("grad", "A", day("2024-07-01"), None), ("grad", "B", day("2024-06-01"), 2.0)
    ]
    added = rows_of(plans.upsert_holding(tables, "quant", "A", "2024-07-01", 5.0))
    assert len(added) == 3 and ("quant", "A", day("2024-07-01"), 5.0) in added


def test_upsert_twice_is_upsert_once(spark):
    tables = make_tables(spark, portfolio=[("grad", 0.1, 0.2)])
    once = plans.upsert_portfolio(tables, "quant", 0.3, None)
    twice = plans.upsert_portfolio({"portfolio": once}, "quant", 0.3, None)
    assert rows_of(once) == rows_of(twice) == [("grad", 0.1, 0.2), ("quant", 0.3, None)]


def test_upsert_keeps_other_columns(spark):
    target = spark.createDataFrame([("grad", 0.1, 0.2, "x")], "fund string, benchmark_return double, target_tracking_error double, note string")
    rows = rows_of(plans.upsert_portfolio({"portfolio": target}, "grad", 0.5, 0.6))
    assert rows == [("grad", 0.5, 0.6, "x")]
    new = rows_of(plans.upsert_portfolio({"portfolio": target}, "quant", 0.5, 0.6))
    assert ("quant", 0.5, 0.6, None) in new


def test_duplicate_key_in_a_batch_fails_the_job(spark):
    tables = make_tables(spark, holding=HOLDING)
    for key in (("grad", "A"), ("new", "Z")):
        batch = spark.createDataFrame([(*key, day("2024-01-01"), 1.0)] * 2, tables["holding"].schema)
        with pytest.raises(Exception, match="more than one row per"):
            plans.upsert_holdings(tables, batch).collect()


def test_text_formats(spark):
    frame = spark.createDataFrame(
        [("brigham_capital", 0.12345), ("a_b_c", -12.5), ("all", -0.000001), ("x", None)], "name string, v double"
    )
    rows = {r[0]: r[1:] for r in frame.select("name", titled(F.col("name")), as_percent(F.col("v")), as_number(F.col("v"))).collect()}
    assert rows["brigham_capital"][0] == "Brigham Capital" and rows["all"][0] == "All"
    assert rows["brigham_capital"][1:] == ("12.35%", "0.12")
    assert rows["a_b_c"] == ("A B_c", "-1,250.00%", "-12.50")
    assert rows["all"][1:] == ("-0.00%", "-0.00")
    assert rows["x"][1:] == (None, None)
