"""Two ways to remove duplicate dividend rows.

With ``exact`` all sums and averages are the same to the last bit however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.functions.exact import avg_of, sum_of

ACTION_KEY = ("fund", "ticker", "action_id")


def dividends_by_day(dividends: DataFrame, exact: bool = False) -> DataFrame:
    """All-funds dividends per day: one average per (day, fund, ticker), then the sum."""
    amount = avg_of(F.col("gross_amount"), exact).alias("amount")
    per_holding = dividends.groupBy("caldt", "fund", "ticker").agg(amount)
    return per_holding.groupBy("caldt").agg(sum_of(F.col("amount"), exact).alias("dividends"))


def dividends_by_action(dividends: DataFrame, exact: bool = False) -> DataFrame:
    """One row per corporate action, on its first day, with average rate and amount."""
    return dividends.groupBy(*ACTION_KEY).agg(
        F.min("caldt").alias("caldt"),
        avg_of(F.col("gross_rate"), exact).alias("action_rate"),
        avg_of(F.col("gross_amount"), exact).alias("action_amount"),
    )


def dividends_per_fund_day(actions: DataFrame, exact: bool = False) -> DataFrame:
    return actions.groupBy("caldt", "fund").agg(sum_of(F.col("action_amount"), exact).alias("dividends"))
