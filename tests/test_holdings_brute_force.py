"""Holding series against plain Python on random tables full of edge cases."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest

from fundperf import plans
from tests import brute
from tests.frames import day, make_tables, rows_of

FIRST = day("2024-01-01")
START, END = day("2024-01-06"), day("2024-01-24")
FUNDS, TICKERS = ("grad", "quant"), ("A", "B", "VMFXX")


def random_tables(seed: int) -> dict[str, list[tuple]]:
    rng = random.Random(seed)
    days = [FIRST + timedelta(days=i) for i in range(28)]
    pick = rng.choice

    def some(value, gap=0.05):
        return None if rng.random() < gap else value

    positions = [
        (pick(days), pick(FUNDS), pick(TICKERS), pick(["EQ", "EQ", "EQ", "OPT", "CASH", None]),
         some(float(pick([0, -2, 3, 4, 5, 8]))), some(pick([8.0, 10.0, 12.5])), some(pick([1.0, 1.25])))
        for _ in range(110)
    ]
    trades = [
        (pick(days), pick(FUNDS), pick(TICKERS), pick(["EQ", "EQ", "EQ", "OPT", "CASH"]),
         pick(["BUY", "SELL", "SELL (CA.)"]), some(float(pick([-4, -3, 3, 4]))), some(pick([9.0, 11.0])))
        for _ in range(70)
    ]
    dividends = [
        (pick(days), pick(FUNDS), pick(TICKERS), rng.randrange(9), some(pick([0.25, 0.5])), some(pick([1.0, 2.0])))
        for _ in range(60)
    ]
    # A holding that pays two actions on one day for sure.
    positions.append((days[10], "grad", "A", "EQ", 4.0, 10.0, 1.0))
    dividends += [(days[10], "grad", "A", 100 + i, 0.5, 1.0 + i) for i in range(2)]
    return {
        "positions": positions,
        "trades": trades,
        "dividends": dividends,
        "nav": [(d, f, float(pick([0, 100, 200]))) for d in days for f in FUNDS if rng.random() < 0.9],
        "risk_free_rate": [(d, some(0.001 * i, 0.2)) for i, d in enumerate(days) if rng.random() < 0.7],
        "calendar": [(d,) for d in days if d.isoweekday() <= 5],
    }


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def key(row):
    return tuple((v is not None, str(round(v, 9) + 0.0 if isinstance(v, float) else v)) for v in row)


def assert_same(found, expected):
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def expected_series(data):
    return brute.holding_series(
        data["positions"], data["trades"], data["dividends"], data["nav"], dict(data["risk_free_rate"]),
        {d for (d,) in data["calendar"]}, START, END,
    )


@pytest.mark.parametrize("seed", range(6))
def test_all_holdings(spark, seed):
    data = random_tables(seed)
    expected = expected_series(data)
    tables = make_tables(spark, **data)
    every = rows_of(plans.holding_daily_returns(tables, START, END))
    assert_same(every, expected)
    reported = rows_of(plans.all_holdings_daily_returns(tables, START, END))
    assert_same(reported, [row for row in expected if row[2] != "VMFXX"])


def test_single_holding_and_single_funds_agree_with_the_whole(spark):
    data = random_tables(11)
    tables = make_tables(spark, **data)
    whole = rows_of(plans.all_holdings_daily_returns(tables, START, END))
    one = rows_of(plans.holding_daily_returns(tables, START, END, "grad", "A"))
    assert_same(one, [row for row in whole if row[1:3] == ("grad", "A")])
    by_fund = [
        row for fund in FUNDS for row in rows_of(plans.all_holdings_daily_returns(tables, START, END, [fund]))
    ]
    assert_same(by_fund, whole)


def test_a_hot_holding_keeps_all_rows(spark):
    """A third of all positions in one (fund, ticker, day), another third in one holding."""
    rng = random.Random(3)
    data = random_tables(4)
    hot = day("2024-01-10")
    data["positions"] += [(hot, "grad", "A", "EQ", float(rng.randrange(1, 9)), 10.0, 1.0) for _ in range(3000)]
    data["positions"] += [
        (FIRST + timedelta(days=rng.randrange(28)), "quant", "B", "EQ", float(rng.randrange(1, 9)), 8.0, 1.0)
        for _ in range(3000)
    ]
    data["trades"] += [(hot, "grad", "A", "EQ", "BUY", 1.0, 9.0) for _ in range(500)]
    tables = make_tables(spark, **data)
    assert_same(rows_of(plans.holding_daily_returns(tables, START, END)), expected_series(data))
