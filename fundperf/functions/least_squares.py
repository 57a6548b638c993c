"""Least squares on several regressors per group, in aggregates and expressions.

One aggregate gives the centred sums of products of all columns, over the rows in which none of them is NULL; they merge
map-side like any sum. The few numbers of each group are then eliminated column by column. A group whose
regressors are linearly dependent, or that has fewer rows than coefficients, has NULL coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundperf.functions.stats import ratio

#: A regressor whose part beyond the others is this share of its own squares counts as dependent on them.
DEPENDENT = 1e-12


def least_squares(df: DataFrame, keys: Sequence[str], y: str, regressors: Sequence[str]) -> DataFrame:
    """``keys``, n, intercept, a ``beta_<regressor>`` each and r_squared, of all groups.

    NULL policy: a row counts if y and all regressors are present, and n counts such rows. Rank policy: all
    coefficients are NULL unless the regressors and the constant are independent. r_squared is NULL for a constant y.
    """
    xs = list(regressors)
    whole = F.lit(True)
    for name in (y, *xs):
        whole &= F.col(name).isNotNull()
    values = {name: F.when(whole, F.col(name).cast("double")) for name in (y, *xs)}
    sums = [F.count(values[y]).alias("n")]
    sums += [F.avg(value).alias(f"_mean_{name}") for name, value in values.items()]
    columns = [*xs, y]
    for i, a in enumerate(columns):
        for b in columns[i:]:
            product = F.var_pop(values[a]) if a == b else F.covar_pop(values[a], values[b])
            sums.append(product.alias(f"_c_{i}_{columns.index(b)}"))
    # Row y is the last one of the symmetric matrix, which is eliminated downwards.
    p = len(xs)
    state = df.groupBy(*keys).agg(*sums).withColumn("_full", F.col("n") > p)
    for k in range(p):
        state = state.withColumn(f"_own_{k}", F.col(f"_c_{k}_{k}"))
    for k in range(p):
        pivot = F.col(f"_c_{k}_{k}")
        step: dict[str, Column] = {"_full": F.col("_full") & (pivot > DEPENDENT * F.col(f"_own_{k}"))}
        for i in range(k + 1, p + 1):
            for j in range(i, p + 1):
                step[f"_c_{i}_{j}"] = F.col(f"_c_{i}_{j}") - ratio(F.col(f"_c_{k}_{i}") * F.col(f"_c_{k}_{j}"), pivot)
        state = state.withColumns(step)
    for k in reversed(range(p)):
        known = F.lit(0.0)
        for j in range(k + 1, p):
            known = known + F.col(f"_c_{k}_{j}") * F.col(f"_b_{j}")
        state = state.withColumn(f"_b_{k}", F.when(F.col("_full"), ratio(F.col(f"_c_{k}_{p}") - known, F.col(f"_c_{k}_{k}"))))
    intercept, explained = F.col(f"_mean_{y}"), F.lit(0.0)
    for k, name in enumerate(xs):
        intercept = intercept - F.col(f"_b_{k}") * F.col(f"_mean_{name}")
        # What a column adds, once those before it are eliminated.
        explained = explained + ratio(F.col(f"_c_{k}_{p}") * F.col(f"_c_{k}_{p}"), F.col(f"_c_{k}_{k}"))
    total = explained + F.col(f"_c_{p}_{p}")
    return state.select(
        *keys,
        "n",
        intercept.alias("intercept"),
        *[F.col(f"_b_{k}").alias(f"beta_{name}") for k, name in enumerate(xs)],
        F.when(F.col("_full"), ratio(explained, total)).alias("r_squared"),
    )
