"""Intermediate results in DuckDB SQL.

Where the semantics allow, a stage is written another way than in Spark: the position merge
as a left join plus an anti join, period returns as the last point of a running product.
"""

from __future__ import annotations

START, END = "DATE '1995-07-01'", "DATE '2001-06-29'"
IN_WINDOW = f"caldt BETWEEN {START} AND {END}"


def filled(source: str, partition: str = "", tie_break: str = "") -> str:
    """Rows of ``source`` with the risk-free rate; days without one look back one row."""
    by = f"PARTITION BY {partition}" if partition else ""
    ties = f", {tie_break}" if tie_break else ""
    return f"""
        SELECT s.*, IFNULL(f.rate, LAG(f.rate) OVER ({by} ORDER BY f.caldt ASC NULLS LAST, s.caldt{ties}))
               AS rf_return
        FROM {source} s LEFT JOIN risk_free_rate f ON f.caldt = s.caldt"""


def running(column: str, partition: str = "", order: str = "caldt") -> str:
    """Running compounded return, NULL where the day has none."""
    by = f"PARTITION BY {partition}" if partition else ""
    return (
        f"CASE WHEN {column} IS NOT NULL THEN product(1 + {column}) OVER ({by} ORDER BY {order} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END"
    )


def finite(value: str) -> str:
    return f"CASE WHEN NOT isnan({value}) THEN {value} END"


def annual_std(column: str) -> str:
    return f"stddev_samp({column}) * sqrt(252)"


_WITH_BENCHMARK = """
    b.div_ret, IFNULL(b.div_ret, 0) AS div_ret_0, b.ret AS ret_bmk, IFNULL(b.ret - b.rf_return, 0) AS xs_bmk,
    IFNULL(b.div_ret - b.rf_return, 0) AS xs_div, b.action_id"""

STAGES: dict[str, str] = {
    "div_day": """
        SELECT caldt, SUM(a) AS amount
        FROM (SELECT caldt, AVG(gross_amount) AS a FROM dividends GROUP BY caldt, fund, ticker)
        GROUP BY caldt""",
    "div_action": """
        SELECT fund, ticker, action_id, MIN(caldt) AS caldt, AVG(gross_rate) AS rate, AVG(gross_amount) AS amount
        FROM dividends GROUP BY ALL""",
    "div_fund_day": """
        SELECT caldt, fund, SUM(amount) AS amount FROM div_action GROUP BY ALL""",
    # Series of all funds, of each fund and of the benchmark
    "total_moves": f"""
        SELECT *, ending_value / NULLIF(starting_value, 0) - 1 AS ret
        FROM (SELECT caldt, SUM(starting_value) AS starting_value, SUM(ending_value) AS ending_value
              FROM delta_nav GROUP BY caldt)
        WHERE ret <> 0 AND {IN_WINDOW}""",
    "total_filled": filled("total_moves"),
    "total_series": """
        SELECT t.*, IFNULL(d.amount, 0) AS dividends, ret - rf_return AS xs
        FROM total_filled t LEFT JOIN div_day d USING (caldt)""",
    "fund_moves": f"""
        SELECT caldt, fund, starting_value, ending_value - deposits_withdrawals AS end_net,
               end_net / NULLIF(starting_value, 0) - 1 AS ret
        FROM delta_nav WHERE ret <> 0 AND {IN_WINDOW}""",
    "fund_filled": filled("fund_moves", "s.fund"),
    "fund_series": """
        SELECT t.*, IFNULL(d.amount, 0) AS dividends, ret - rf_return AS xs
        FROM fund_filled t LEFT JOIN div_fund_day d USING (caldt, fund)""",
    "bmk_moves": f"""
        SELECT l.*, d.rate AS dividends, d.action_id, ending_value / starting_value - 1 AS ret,
               (ending_value + IFNULL(d.rate, 0)) / starting_value - 1 AS div_ret
        FROM (SELECT caldt, ending_value, LAG(ending_value) OVER (ORDER BY caldt) AS starting_value FROM bmk) l
        LEFT JOIN (FROM div_action WHERE fund = 'undergrad' AND ticker = 'IWV') d ON d.caldt = l.caldt
        WHERE l.{IN_WINDOW} AND ending_value / starting_value <> 1""",
    "bmk_series": filled("bmk_moves", tie_break="s.action_id"),
    # Holdings
    "pos_avg": """
        SELECT caldt, fund, ticker, AVG(shares) AS shares_1, AVG(price) AS price_1, AVG(fx_rate) AS fx_rate_1,
               CASE WHEN shares_1 > 0 THEN 1 ELSE -1 END AS side
        FROM positions WHERE asset_class <> 'OPT' GROUP BY caldt, fund, ticker""",
    "trade_net": """
        SELECT caldt, fund, ticker, SUM(shares_traded) AS net, AVG(price_traded) AS trade_price,
               CASE WHEN net > 0 THEN 1 ELSE -1 END AS trade_sign
        FROM trades WHERE asset_class NOT IN ('OPT', 'CASH') AND buy_sell <> 'SELL (CA.)'
        GROUP BY caldt, fund, ticker HAVING SUM(shares_traded) <> 0""",
    "merged": """
        SELECT p.*, t.trade_sign, IFNULL(t.net, 0) AS shares_traded, t.trade_price, d.action_id,
               IFNULL(d.rate, 0) AS action_rate, IFNULL(d.amount, 0) AS dividends
        FROM pos_avg p LEFT JOIN trade_net t USING (caldt, fund, ticker)
        LEFT JOIN div_action d USING (caldt, fund, ticker)
        UNION ALL BY NAME
        SELECT t.caldt, t.fund, t.ticker, t.trade_sign, t.net AS shares_traded, t.trade_price,
               0.0::DOUBLE AS action_rate, 0.0::DOUBLE AS dividends
        FROM trade_net t ANTI JOIN pos_avg p USING (caldt, fund, ticker)""",
    "lags": """
        SELECT *, LAG(side) OVER h AS previous_side, LAG(shares_1) OVER h AS previous_shares,
               LAG(price_1) OVER h AS previous_price, LAG(fx_rate_1) OVER h AS previous_fx_rate
        FROM merged WINDOW h AS (PARTITION BY fund, ticker ORDER BY caldt, action_id)""",
    "states": """
        SELECT caldt, fund, ticker, action_id, IFNULL(previous_side, side) AS side,
               IFNULL(previous_shares, shares_traded) AS shares_0,
               CASE WHEN shares_1 IS NULL THEN -shares_traded
                    WHEN shares_1 = shares_traded THEN shares_1 ELSE shares_1 - shares_traded END AS shares_1,
               IFNULL(previous_price, trade_price) AS price_0, IFNULL(price_1, trade_price) AS price_1,
               IFNULL(previous_fx_rate, fx_rate_1) AS fx_rate_0, IFNULL(fx_rate_1, previous_fx_rate) AS fx_rate_1,
               trade_sign, shares_traded, trade_price, action_rate, dividends
        FROM lags""",
    "valued": """
        SELECT *, shares_0 * price_0 * fx_rate_0 AS value_0, shares_1 * price_1 * fx_rate_1 AS value_1
        FROM states""",
    "returned": """
        SELECT v.*, NULLIF(n.stock, 0) AS stock_value, value_1 / NULLIF(n.stock, 0) AS weight_after,
               IF(side = 1, value_1, value_0) / NULLIF(IF(side = 1, value_0, value_1), 0) - 1 AS ret,
               IF(side = 1, value_1 + dividends, value_0)
                   / NULLIF(IF(side = 1, value_0, value_1 + dividends), 0) - 1 AS div_ret
        FROM valued v LEFT JOIN nav n USING (caldt, fund)""",
    "holding_days": f"""
        SELECT * FROM returned SEMI JOIN calendar USING (caldt) WHERE {IN_WINDOW}""",
    "holding_series": filled("holding_days", "s.fund, s.ticker", "s.action_id"),
    # Latest positions
    "last_positions": """
        SELECT p.* FROM positions p JOIN (SELECT fund, MAX(caldt) AS caldt FROM positions GROUP BY fund)
        USING (fund, caldt)""",
    "held_now": """
        SELECT fund, ticker FROM last_positions WHERE asset_class <> 'OPT' AND asset_class <> 'CASH'""",
    # Statistics
    "total_joined": f"""
        SELECT s.*, {_WITH_BENCHMARK} FROM total_series s LEFT JOIN bmk_series b USING (caldt)""",
    "fund_joined": f"""
        SELECT s.*, {_WITH_BENCHMARK} FROM fund_series s LEFT JOIN bmk_series b USING (caldt)""",
    "total_stats": f"""
        SELECT *, expected_return / volatility AS sharpe_ratio, alpha / tracking_error AS information_ratio
        FROM (SELECT last(cum ORDER BY caldt, action_id) AS total_return, {annual_std("ret")} AS volatility,
                     SUM(dividends) AS dividends, {finite("regr_intercept(xs, xs_div)")} AS alpha,
                     {finite("regr_slope(xs, xs_div)")} AS beta, {annual_std("xs - xs_div")} AS tracking_error,
                     AVG(xs) * 252 AS expected_return
              FROM (SELECT *, {running("ret", order="caldt, action_id")} AS cum FROM total_joined))""",
    "fund_stats": f"""
        SELECT *, total_return - beta * total_return_bmk AS alpha, expected_return / volatility AS sharpe_ratio,
               alpha / tracking_error AS information_ratio
        FROM (SELECT fund, last(cum ORDER BY caldt, action_id) AS total_return,
                     last(cum_bmk ORDER BY caldt, action_id) AS total_return_bmk,
                     {annual_std("ret")} AS volatility, SUM(dividends) AS dividends,
                     {finite("regr_slope(xs, xs_bmk)")} AS beta,
                     {finite("regr_intercept(xs, xs_bmk)")} AS daily_alpha,
                     {annual_std("xs - xs_div")} AS tracking_error, AVG(xs) * 252 AS expected_return
              FROM (SELECT *, {running("ret", "fund", "caldt, action_id")} AS cum,
                           {running("ret_bmk", "fund", "caldt, action_id")} AS cum_bmk FROM fund_joined)
              GROUP BY fund)""",
    "report": """
        SELECT CASE fund WHEN 'grad' THEN 'Grad' WHEN 'undergrad' THEN 'Undergrad' WHEN 'quant' THEN 'Quant'
                    ELSE 'Brigham Capital' END AS fund,
               total_return, volatility, alpha, beta, tracking_error, sharpe_ratio, information_ratio
        FROM fund_stats
        UNION ALL
        SELECT 'All', total_return, volatility, alpha, beta, tracking_error, sharpe_ratio, information_ratio
        FROM total_stats""",
    "holdings_joined": """
        SELECT h.*, b.div_ret AS div_ret_bmk, b.action_id AS bmk_action, IFNULL(h.div_ret - h.rf_return, 0) AS xs_div,
               IFNULL(b.div_ret - b.rf_return, 0) AS xs_div_bmk
        FROM (SELECT * FROM holding_series SEMI JOIN held_now USING (fund, ticker) WHERE ticker <> 'VMFXX') h
        LEFT JOIN bmk_series b USING (caldt)""",
    "holdings_stats": f"""
        SELECT *, total_return - beta * total_return_bmk AS alpha
        FROM (SELECT fund, ticker, last(cum ORDER BY caldt, action_id, bmk_action) AS total_return,
                     last(cum_bmk ORDER BY caldt, action_id, bmk_action) AS total_return_bmk,
                     last(weight_after ORDER BY caldt, action_id, bmk_action) AS weight,
                     {annual_std("div_ret")} AS volatility, {finite("regr_slope(xs_div, xs_div_bmk)")} AS beta
              FROM (SELECT *, {running("div_ret", "fund, ticker", "caldt, action_id, bmk_action")} AS cum,
                           {running("div_ret_bmk", "fund, ticker", "caldt, action_id, bmk_action")} AS cum_bmk
                    FROM holdings_joined)
              GROUP BY fund, ticker)""",
}
