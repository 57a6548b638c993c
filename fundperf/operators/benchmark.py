"""Putting benchmark returns next to a daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENCHMARK_RETURNS = ("return", "div_return", "xs_return", "xs_div_return")


def benchmark_join(
    series: DataFrame, benchmark: DataFrame, columns: Sequence[str] = BENCHMARK_RETURNS
) -> DataFrame:
    """Left join on the day; names the series already has get the suffix ``_bmk``."""
    taken = set(series.columns)
    wanted = benchmark.select(
        "caldt", *[F.col(c).alias(f"{c}_bmk" if c in taken else c) for c in columns]
    )
    return series.join(wanted, "caldt", "left")
