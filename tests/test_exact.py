"""Sums of decimal amounts: equal to the last bit however the rows are partitioned."""

from __future__ import annotations

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fundperf import operators
from fundperf.functions.exact import exact_avg, exact_std, exact_sum
from tests.frames import day, make_tables

PARTITIONINGS = [(1, 0), (2, 1), (3, 5), (7, 2), (13, 11)]


def dealt(df, partitions, seed):
    return df.orderBy(F.rand(seed)).repartition(partitions, F.rand(seed + 1))


def bits(df) -> list[tuple]:
    return sorted(tuple(v.hex() if isinstance(v, float) else v for v in row) for row in df.collect())


def amounts(seed=41, n=4000):
    rng = random.Random(seed)
    return [(i % 3, round(rng.uniform(-1e6, 1e6), 2) + rng.choice([0.1, 0.2, 0.3])) for i in range(n)]


def test_sums_are_equal_under_five_partitionings(spark):
    frame = spark.createDataFrame(amounts(), "k int, v double")
    aggregates = [exact_sum(F.col("v")), exact_avg(F.col("v")), exact_std(F.col("v") / 1e8)]
    found = {str(bits(dealt(frame, *p).groupBy("k").agg(*aggregates))) for p in PARTITIONINGS}
    assert len(found) == 1
    plain = {str(bits(dealt(frame, *p).groupBy("k").agg(F.sum("v"), F.avg("v")))) for p in PARTITIONINGS}
    assert len(plain) > 1, "the rows must be such that the order matters"


def test_sums_are_those_of_the_rounded_values(spark):
    rows = amounts(42, 500)
    got = {r[0]: r for r in spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(
        exact_sum(F.col("v")), exact_avg(F.col("v")), exact_std(F.col("v") / 1e8)).collect()}
    for k in range(3):
        own = [v for i, v in rows if i == k]
        assert got[k][1] == float(sum(Fraction(round(v * 10**9), 10**9) for v in own)) or math.isclose(got[k][1], math.fsum(own), rel_tol=1e-15)
        assert math.isclose(got[k][2], math.fsum(own) / len(own), rel_tol=1e-14)
        assert math.isclose(got[k][3], statistics.stdev(v / 1e8 for v in own), rel_tol=1e-9)


def test_nothing_one_value_and_too_large_ones(spark):
    frame = spark.createDataFrame([(1, None), (2, 0.1), (2, None)], "k int, v double")
    got = {r[0]: tuple(r)[1:] for r in frame.groupBy("k").agg(exact_sum(F.col("v")), exact_avg(F.col("v")), exact_std(F.col("v"))).collect()}
    assert got == {1: (None, None, None), 2: (0.1, 0.1, None)}
    for value in (1e40, math.inf, math.nan):
        with pytest.raises(Exception):
            spark.createDataFrame([(value,)], "v double").agg(exact_sum(F.col("v"))).collect()


def test_dividends_and_positions_of_decimal_amounts(spark):
    rng = random.Random(43)
    days, funds, tickers = [day(f"2024-01-{d:02d}") for d in (2, 3)], ("grad", "quant"), ("A", "B")
    pick = rng.choice
    dividends = [(pick(days), pick(funds), pick(tickers), rng.randrange(3), round(rng.random(), 3), round(rng.uniform(0, 99), 2)) for _ in range(600)]
    positions = [(pick(days), pick(funds), pick(tickers), "EQ", round(rng.uniform(-9, 9), 1), round(rng.uniform(1, 99), 2), 1.1) for _ in range(600)]
    trades = [(pick(days), pick(funds), pick(tickers), "EQ", "BUY", round(rng.uniform(-9, 9), 1), round(rng.uniform(1, 99), 2)) for _ in range(600)]
    # Opposite trades that net to nothing exactly, and to a rest if added as doubles in some order.
    trades += [(day("2024-01-04"), "grad", "A", "EQ", "BUY", v, 1.0) for v in (0.1, 0.2, 0.3, -0.3, -0.2, -0.1, 0.7, -0.7)]
    tables = make_tables(spark, dividends=dividends, positions=positions, trades=trades)

    def results(partitions, seed, exact):
        d, p, t = (dealt(tables[name], partitions, seed) for name in ("dividends", "positions", "trades"))
        actions = operators.dividends_by_action(d, exact)
        frames = (operators.dividends_by_day(d, exact), actions, operators.dividends_per_fund_day(actions, exact),
                  operators.position_snapshot(p, exact), operators.net_trades(t, exact))
        return [bits(f) for f in frames]

    found = [results(*p, True) for p in PARTITIONINGS]
    assert all(f == found[0] for f in found)
    assert not any("2024, 1, 4" in str(row[0:1]) for row in found[0][4])
    assert len({str(results(*p, False)) for p in PARTITIONINGS}) > 1
    rounded = [[tuple(round(float.fromhex(v), 6) if isinstance(v, str) and "0x" in v else v for v in row) for row in frame] for frame in found[0][:4]]
    plain = [[tuple(round(float.fromhex(v), 6) if isinstance(v, str) and "0x" in v else v for v in row) for row in frame] for frame in results(3, 5, False)[:4]]
    assert [sorted(map(str, f)) for f in rounded] == [sorted(map(str, f)) for f in plain]
