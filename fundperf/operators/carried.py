"""What a run over holdings must remember of all days before it: one row per holding, and sums per dividend action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.constants import HOLDING_KEY
from fundperf.operators.dividends import ACTION_KEY
from fundperf.operators.positions import lag_state

#: The columns of merged rows that the next row of a holding looks back to.
CARRIED = ("side", "shares_1", "price_1", "fx_rate_1")
STATE = (*HOLDING_KEY, "caldt", "action_id", *CARRIED)


def last_state(merged: DataFrame) -> DataFrame:
    """The last row of each holding: by day, and on a day by dividend action as the lag orders them."""
    last = F.max_by(F.struct(*CARRIED), F.struct("caldt", "action_id"))
    place = F.max(F.struct("caldt", "action_id"))
    return (
        merged.groupBy(*HOLDING_KEY)
        .agg(place.alias("_place"), last.alias("_last"))
        .select(*HOLDING_KEY, "_place.caldt", "_place.action_id", *[f"_last.{name}" for name in CARRIED])
    )


def merged_state(state: DataFrame, merged: DataFrame) -> DataFrame:
    """The state after the days of ``merged``, which all follow those of ``state``."""
    return last_state(state.select(*STATE).unionByName(merged.select(*STATE)))


def lag_from_state(state: DataFrame, merged: DataFrame) -> DataFrame:
    """The previous row's values for rows of new days, with the state in the place of all days before.

    The state is one more row of each holding's window, so nothing older is read, shuffled or sorted.
    """
    marked = merged.withColumn("_carried", F.lit(False)).unionByName(
        state.select(*STATE).withColumn("_carried", F.lit(True)), allowMissingColumns=True
    )
    return lag_state(marked).filter(~F.col("_carried")).drop("_carried")


def action_state(dividends: DataFrame) -> DataFrame:
    """Sums and counts of each dividend action, from which averages over more rows can be made."""
    return dividends.groupBy(*ACTION_KEY).agg(
        F.min("caldt").alias("first_day"),
        F.sum("gross_rate").alias("rate_sum"),
        F.count("gross_rate").alias("rate_count"),
        F.sum("gross_amount").alias("amount_sum"),
        F.count("gross_amount").alias("amount_count"),
    )


def actions_paid(state: DataFrame, dividends: DataFrame) -> DataFrame:
    """The part of the action state that ``dividends`` have rows of; null keys are keys like any other, as in the sums."""
    paid = dividends.select(*[F.col(name).alias(f"_{name}") for name in ACTION_KEY]).distinct()
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in ACTION_KEY]
    return state.join(paid, same, "left_semi")


def merged_actions(state: DataFrame, dividends: DataFrame) -> DataFrame:
    """The action state with more dividend rows, of whatever days."""
    return (
        state.unionByName(action_state(dividends))
        .groupBy(*ACTION_KEY)
        .agg(
            F.min("first_day").alias("first_day"),
            *[F.sum(name).alias(name) for name in ("rate_sum", "rate_count", "amount_sum", "amount_count")],
        )
    )


def actions_of(state: DataFrame) -> DataFrame:
    """One row per action, on its first day, with average rate and amount."""
    return state.selectExpr(
        *ACTION_KEY,
        "first_day AS caldt",
        "try_divide(rate_sum, rate_count) AS action_rate",
        "try_divide(amount_sum, amount_count) AS action_amount",
    )
