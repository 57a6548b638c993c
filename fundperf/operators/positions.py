"""From positions, trades and dividends to daily holding returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundperf.constants import (
    CORPORATE_ACTION_SELL,
    EXCLUDED_ASSET_CLASSES,
    OPTION_CLASS,
    POSITION_KEY,
)
from fundperf.functions.exact import avg_of, sum_of

# Dividend actions may put several rows on one day of a holding; the action settles their order.
HISTORY = "(PARTITION BY fund, ticker ORDER BY caldt, action_id)"


def _sign(value: str) -> str:
    return f"CASE WHEN {value} > 0 THEN 1 ELSE -1 END"


def _eligible_positions(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("asset_class") != OPTION_CLASS)


def _eligible_trades(trades: DataFrame) -> DataFrame:
    return trades.filter(
        ~F.col("asset_class").isin(*EXCLUDED_ASSET_CLASSES) & (F.col("buy_sell") != CORPORATE_ACTION_SELL)
    )


def position_snapshot(positions: DataFrame, exact: bool = False) -> DataFrame:
    """Average state per (day, fund, ticker) without options; side -1 unless shares are positive.

    With ``exact`` the averages don't depend on how the rows are partitioned.
    """
    averages = _eligible_positions(positions).groupBy(*POSITION_KEY).agg(
        avg_of(F.col("shares"), exact).alias("shares_1"),
        avg_of(F.col("price"), exact).alias("price_1"),
        avg_of(F.col("fx_rate"), exact).alias("fx_rate_1"),
    )
    return averages.selectExpr(*POSITION_KEY, f"{_sign('shares_1')} AS side", "shares_1", "price_1", "fx_rate_1")


def net_trades(trades: DataFrame, exact: bool = False) -> DataFrame:
    """Net shares and average price per (day, fund, ticker); trades that net to zero vanish.

    With ``exact`` opposite trades of decimal shares net to zero however the rows are partitioned.
    """
    net = _eligible_trades(trades).groupBy(*POSITION_KEY).agg(
        sum_of(F.col("shares_traded"), exact).alias("shares_traded"),
        avg_of(F.col("price_traded"), exact).alias("trade_price"),
    )
    return net.filter("shares_traded <> 0").selectExpr(
        *POSITION_KEY, f"{_sign('shares_traded')} AS trade_sign", "shares_traded", "trade_price"
    )


def position_trade_merge(positions: DataFrame, trades: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions and net trades side by side, plus the dividends of position rows.

    A full outer join of the two aggregates on their own grouping key is the same as one
    aggregate over both inputs stacked: a single map-side combined shuffle and no sort-merge.
    Rows that only a trade produced get no dividend.
    """
    stacked = (
        _eligible_positions(positions)
        .selectExpr(*POSITION_KEY, "true AS held", "shares", "price", "fx_rate")
        .unionByName(
            _eligible_trades(trades).selectExpr(
                *POSITION_KEY, "false AS held", "shares_traded", "price_traded"
            ),
            allowMissingColumns=True,
        )
    )
    # A day's trades count only if they do not net to zero.
    merged = (
        stacked.groupBy(*POSITION_KEY)
        .agg(
            F.max("held").alias("held"),
            F.avg("shares").alias("shares_1"),
            F.avg("price").alias("price_1"),
            F.avg("fx_rate").alias("fx_rate_1"),
            F.sum("shares_traded").alias("net"),
            F.avg("price_traded").alias("price_traded"),
        )
        .filter("held OR net <> 0")
        .selectExpr(
            *POSITION_KEY,
            f"CASE WHEN held THEN {_sign('shares_1')} END AS side",
            "shares_1",
            "price_1",
            "fx_rate_1",
            f"CASE WHEN net <> 0 THEN {_sign('net')} END AS trade_sign",
            "CASE WHEN net <> 0 THEN net ELSE 0D END AS shares_traded",
            "CASE WHEN net <> 0 THEN price_traded END AS trade_price",
        )
    )
    paid = actions.selectExpr(
        *[f"{name} AS _{name}" for name in POSITION_KEY],
        "action_id",
        "action_rate AS _rate",
        "action_amount AS _amount",
    )
    same_key = " AND ".join(f"{name} = _{name}" for name in POSITION_KEY)
    return merged.join(paid, F.expr(f"side IS NOT NULL AND {same_key}"), "left").selectExpr(
        *POSITION_KEY,
        "side",
        "shares_1",
        "price_1",
        "fx_rate_1",
        "trade_sign",
        "shares_traded",
        "trade_price",
        "action_id",
        "coalesce(_rate, 0D) AS action_rate",
        "coalesce(_amount, 0D) AS dividends",
    )


def lag_state(merged: DataFrame) -> DataFrame:
    """The previous row's side, shares, price and currency rate of each holding, over all history.

    A holding has one row per day and dividend action here, however often it is booked.
    """
    return merged.selectExpr(
        "*",
        f"lag(side) OVER {HISTORY} AS previous_side",
        f"lag(shares_1) OVER {HISTORY} AS previous_shares",
        f"lag(price_1) OVER {HISTORY} AS previous_price",
        f"lag(fx_rate_1) OVER {HISTORY} AS previous_fx_rate",
    )


def lagged_position_state(merged: DataFrame) -> DataFrame:
    """State before (``_0``) and after (``_1``) each day, with fallbacks for missing sides."""
    return position_state(lag_state(merged))


def position_state(lagged: DataFrame) -> DataFrame:
    """State before and after each day of merged rows that know their previous row.

    The side is the previous row's. Shares after the day are net of the day's trades, unless
    that leaves nothing; a row that only a trade produced counts as its shares reversed.
    """
    return lagged.selectExpr(
        *POSITION_KEY,
        "action_id",
        "coalesce(previous_side, side) AS side",
        "coalesce(previous_shares, shares_traded) AS shares_0",
        "coalesce(nullif(shares_1 - shares_traded, 0D), shares_1, -shares_traded) AS shares_1",
        "coalesce(previous_price, trade_price) AS price_0",
        "coalesce(price_1, trade_price) AS price_1",
        "coalesce(previous_fx_rate, fx_rate_1) AS fx_rate_0",
        "coalesce(fx_rate_1, previous_fx_rate) AS fx_rate_1",
        "trade_sign",
        "shares_traded",
        "trade_price",
        "action_rate",
        "dividends",
    )


def position_values(state: DataFrame) -> DataFrame:
    return state.selectExpr(
        "*",
        "shares_0 * price_0 * fx_rate_0 AS value_0",
        "shares_1 * price_1 * fx_rate_1 AS value_1",
    )


def _return(after: str) -> str:
    """Gain of a long holding; a short one gains when its value falls."""
    return (
        f"CASE WHEN side = 1 THEN try_divide({after}, value_0) ELSE try_divide(value_0, {after}) END - 1"
    )


def position_returns(values: DataFrame, nav: DataFrame) -> DataFrame:
    """Weight in the fund's stock value, price return and dividend-inclusive return."""
    stock = nav.filter("stock <> 0").selectExpr("caldt", "fund", "stock AS stock_value")
    return values.join(stock, ["caldt", "fund"], "left").selectExpr(
        *POSITION_KEY,
        "action_id",
        "side",
        "shares_1",
        "price_1",
        "fx_rate_1",
        "value_1",
        "stock_value",
        "try_divide(value_1, stock_value) AS weight_after",
        "action_rate",
        "dividends",
        f"{_return('value_1')} AS return",
        f"{_return('(value_1 + dividends)')} AS div_return",
    )
