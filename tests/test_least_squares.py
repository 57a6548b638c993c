"""Least squares on several regressors against numpy and the built-in regression of one."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundperf import plans
from fundperf.functions.least_squares import least_squares
from fundperf.sources import demo_tables

SF_DIR = "/root/testdata/sf0.001"


def rows_for(seed, n=120, columns=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        xs = [rng.gauss(5, 2) for _ in range(columns)]
        y = 1.5 + sum((k + 1) * x for k, x in enumerate(xs)) + rng.gauss(0, 1)
        values = [y, *xs]
        out.append(("a" if i % 2 else "b", *[None if rng.random() < 0.05 else v for v in values]))
    return out


@pytest.mark.parametrize("p", [1, 2, 3, 4])
def test_coefficients_equal_those_of_numpy(spark, p):
    rows = rows_for(p)
    frame = spark.createDataFrame(rows, "g string, y double, x1 double, x2 double, x3 double, x4 double").repartition(3)
    names = [f"x{k + 1}" for k in range(p)]
    for row in least_squares(frame, ["g"], "y", names).collect():
        kept = [r[1 : 2 + p] for r in rows if r[0] == row["g"] and None not in r[1 : 2 + p]]
        a = np.array([[1.0, *r[1:]] for r in kept])
        y = np.array([r[0] for r in kept])
        solution, *_ = np.linalg.lstsq(a, y, rcond=None)
        assert row["n"] == len(kept)
        assert np.allclose([row["intercept"], *[row[f"beta_{x}"] for x in names]], solution, rtol=1e-9)
        residual = y - a @ solution
        assert math.isclose(row["r_squared"], 1 - residual @ residual / ((y - y.mean()) @ (y - y.mean())), rel_tol=1e-9)


def test_one_regressor_equals_the_built_in_regression(spark):
    frame = spark.createDataFrame(rows_for(9), "g string, y double, x1 double, x2 double, x3 double, x4 double")
    built_in = frame.groupBy("g").agg(F.regr_slope("y", "x1"), F.regr_intercept("y", "x1"), F.regr_r2("y", "x1"), F.regr_count("y", "x1"))
    own = least_squares(frame, ["g"], "y", ["x1"]).select("g", "beta_x1", "intercept", "r_squared", "n")
    for a, b in zip(sorted(map(tuple, own.collect())), sorted(map(tuple, built_in.collect()))):
        assert a[0] == b[0] and all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a[1:], b[1:]))


def test_dependent_regressors_and_too_few_rows_have_no_coefficients(spark):
    rows = [("twice", float(i), i % 5 * 1.0, i % 5 * 2.0) for i in range(20)]
    rows += [("constant", float(i), i % 5 * 1.0, 7.0) for i in range(20)]
    rows += [("few", 1.0, 2.0, 3.0), ("few", 2.0, 5.0, 3.5), ("none", None, 1.0, 2.0)]
    rows += [("just enough", float(i * i), float(i), float(i % 2)) for i in range(3)]
    rows += [("flat", 4.0, float(i), float(i * i % 7)) for i in range(9)]
    got = {r["g"]: r for r in least_squares(spark.createDataFrame(rows, "g string, y double, x1 double, x2 double"), ["g"], "y", ["x1", "x2"]).collect()}
    for name in ("twice", "constant", "few", "none"):
        assert got[name]["beta_x1"] is got[name]["beta_x2"] is got[name]["intercept"] is got[name]["r_squared"] is None
    assert got["none"]["n"] == 0 and math.isclose(got["just enough"]["r_squared"], 1.0)
    assert got["flat"]["beta_x1"] == 0.0 and got["flat"]["intercept"] == 4.0 and got["flat"]["r_squared"] is None


def test_a_model_of_one_factor_is_the_regression_of_the_report(spark):
    tables, window = demo_tables(spark, SF_DIR), ("1996-02-14", "2000-09-20")
    betas = {r["fund"]: r["beta"] for r in plans.fund_performance(tables, *window).collect()}
    for row in plans.fund_factor_model(tables, *window, ["xs_return_bmk"]).collect():
        assert math.isclose(row["beta_xs_return_bmk"], betas[row["fund"]], rel_tol=1e-10)
    three = plans.fund_factor_model(tables, *window, ["xs_return_bmk", "paid", "payout"]).collect()
    assert len(three) == 4 and all(0 < r["r_squared"] < 1 for r in three)
    for wrong in (["beta"], []):
        with pytest.raises(ValueError, match="factors"):
            plans.fund_factor_model(tables, *window, wrong)
