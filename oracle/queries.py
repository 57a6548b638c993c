"""One DuckDB statement per query name."""

from __future__ import annotations

import re

from oracle.stages import END, IN_WINDOW, STAGES, START, annual_std, finite, running
from oracle.views import VIEWS

CTES = {**VIEWS, **STAGES}
_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def _needed(sql: str) -> set[str]:
    """Names of all CTEs a text mentions, directly or through other CTEs."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        new = set(_NAMES.findall(todo.pop())) - found
        found |= new
        todo += [CTES[name] for name in new]
    return found


def statement(body: str) -> str:
    needed = _needed(body)
    ctes = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def six(value: str, places: int = 6) -> str:
    """A double to six places or more, halves upwards, as plain arithmetic."""
    return f"FLOOR(({value}) * 1e{places} + 0.5) / 1e{places}"


def rounded(source: str, plain: str, doubles: str, places: int = 6) -> str:
    """Select plain columns and rounded doubles; ``a=b`` renames a to b."""
    pairs = [item.partition("=") for item in plain.split()]
    columns = [f'{a} AS "{b or a}"' for a, _, b in pairs]
    pairs = [item.partition("=") for item in doubles.split()]
    columns += [f'{six(a, places)} AS "{b or a}"' for a, _, b in pairs]
    return f"SELECT {', '.join(columns)} FROM {source}"


def _percent(value: str) -> str:
    return f"format('{{:,.2f}}%', ROUND({value} * 100, 2))"


def _number(value: str) -> str:
    return f"format('{{:,.2f}}', ROUND({value}, 2))"


_HOLDING_PLAIN = "caldt fund ticker side"
_HOLDING_DOUBLES = (
    "price_1=price shares_1=shares fx_rate_1=fx_rate value_1=value weight_after=weight "
    "action_rate/price_1=dividend_yield dividends ret=return div_ret=div_return rf_return "
    "ret-rf_return=xs_return div_ret-rf_return=xs_div_return"
)
_STATE_PLAIN = "caldt fund ticker action_id side trade_sign"
_STATE_DOUBLES = (
    "shares_0 shares_1 price_0 price_1 fx_rate_0 fx_rate_1 shares_traded trade_price action_rate dividends"
)
_BENCHMARK_DOUBLES = (
    "starting_value ending_value dividends dividends/ending_value=dividend_yield ret=return div_ret=div_return "
    "rf_return ret-rf_return=xs_return div_ret-rf_return=xs_div_return"
)
_ALL_MEASURES = "total_return volatility dividends alpha beta tracking_error sharpe_ratio information_ratio"
_POSITION_DOUBLES = "shares price fx_rate"

# Fresh targets for what is held on the last days, then those of one fund raised.
_RAISED = """
    (SELECT fund, ticker, CASE WHEN fund = 'quant' THEN CAST(horizon_date + 30 AS DATE) ELSE horizon_date END AS horizon_date,
            CASE WHEN fund = 'quant' THEN target_price * 2 ELSE target_price END AS target_price
     FROM (SELECT fund, ticker, CAST(MAX(caldt) + 180 AS DATE) AS horizon_date, MAX(price) * 1.25 AS target_price
           FROM last_positions GROUP BY fund, ticker
           UNION ALL
           SELECT fund, ticker, horizon_date, target_price
           FROM holding ANTI JOIN last_positions USING (fund, ticker)))"""
_MONEY = "FLOOR(dividends*1e6+0.5)/1e6=dividends"

_BODIES: dict[str, str] = {
    "total_daily_returns": rounded(
        "total_series", "caldt", "starting_value ending_value dividends ret=return rf_return xs=xs_return"
    ),
    "fund_daily_returns": rounded(
        "fund_series",
        "caldt fund",
        "starting_value end_net=ending_value dividends ret=return rf_return xs=xs_return",
    ),
    "holding_daily_returns": rounded("holding_series", _HOLDING_PLAIN, _HOLDING_DOUBLES),
    "all_holdings_daily_returns": rounded(
        "holding_series WHERE ticker <> 'VMFXX'", _HOLDING_PLAIN, _HOLDING_DOUBLES
    ),
    "benchmark_daily_returns": rounded("bmk_series", "caldt", _BENCHMARK_DOUBLES),
    "traded_tickers": f"""
        SELECT DISTINCT fund, ticker FROM positions
        WHERE asset_class NOT IN ('OPT', 'CASH') AND {IN_WINDOW}""",
    "current_tickers": "SELECT fund, ticker FROM held_now",
    "dividend_history": f"""
        SELECT fund, MIN(caldt) AS caldt, ticker, action_id, {six("AVG(gross_rate)")} AS gross_rate,
               {six("AVG(gross_amount)")} AS gross_amount
        FROM dividends WHERE {IN_WINDOW} GROUP BY fund, ticker, action_id""",
    "trade_history": f"""
        SELECT caldt, fund, ticker, SUM(shares_traded) AS shares, {six("AVG(price_traded)")} AS price,
               {six("SUM(shares_traded) * AVG(price_traded)")} AS value, buy_sell AS side
        FROM trades WHERE {IN_WINDOW} GROUP BY caldt, fund, ticker, buy_sell""",
    "recent_logs": rounded(
        "(SELECT *, dense_rank() OVER (ORDER BY caldt DESC) AS day_rank FROM logs) WHERE day_rank <= 5",
        "caldt fund event_id status",
        "elapsed",
    ),
    "logs_by_fund": rounded(
        "logs WHERE caldt BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND fund IN ('grad', 'quant')",
        "caldt fund event_id status",
        "elapsed",
    ),
    "portfolio_defaults": rounded("portfolio", "fund", "benchmark_return target_tracking_error"),
    "upsert_portfolio": rounded(
        """(SELECT * FROM portfolio WHERE fund <> 'grad'
            UNION ALL VALUES ('grad', 0.09::DOUBLE, 0.04::DOUBLE), ('omega', 0.07::DOUBLE, NULL))""",
        "fund",
        "benchmark_return target_tracking_error",
    ),
    "current_holdings": rounded(
        """last_positions JOIN nav USING (caldt, fund) LEFT JOIN holding USING (fund, ticker)""",
        "fund ticker horizon_date",
        "shares price price*shares=value target_price price*shares/NULLIF(stock,0)=weight",
    ),
    "upsert_holding": rounded(
        """(SELECT fund, ticker, CAST(MAX(caldt) + 180 AS DATE) AS horizon_date, MAX(price) * 1.25 AS target_price
            FROM last_positions GROUP BY fund, ticker
            UNION ALL
            SELECT fund, ticker, horizon_date, target_price
            FROM holding ANTI JOIN last_positions USING (fund, ticker))""",
        "fund ticker horizon_date",
        "target_price",
    ),
    "ticker_universe": """
        SELECT l.fund AS universe, p.ticker
        FROM (VALUES ('grad'), ('undergrad'), ('brigham_capital'), ('quant')) l(fund)
        LEFT JOIN positions p ON p.fund = l.fund AND p.caldt = DATE '2001-06-25'
        UNION ALL
        (SELECT DISTINCT 'all_tickers', ticker FROM positions WHERE caldt = DATE '2001-06-25')""",
    "total_performance": rounded("total_stats", "", _ALL_MEASURES, 10),
    "fund_performance": rounded("fund_stats", "fund", _ALL_MEASURES + " total_return_bmk", 10),
    "performance_report": rounded("report", "fund", _ALL_MEASURES.replace("dividends ", ""), 10),
    "performance_report_formatted": f"""
        SELECT fund AS "Fund", {_percent("total_return")} AS "Total Return", {_percent("volatility")} AS "Volatility",
               {_percent("alpha")} AS "Alpha", {_number("beta")} AS "Beta",
               {_percent("tracking_error")} AS "Tracking Error", {_number("sharpe_ratio")} AS "Sharpe Ratio",
               {_number("information_ratio")} AS "Information Ratio"
        FROM report""",
    "holdings_performance": rounded(
        "holdings_stats", "fund ticker", "weight total_return volatility alpha beta", 8
    ),
    "holdings_report_formatted": f"""
        SELECT CASE fund WHEN 'grad' THEN 'Grad' WHEN 'undergrad' THEN 'Undergrad' WHEN 'quant' THEN 'Quant'
                    ELSE 'Brigham Capital' END AS "Fund", ticker AS "Ticker", {_percent("weight")} AS "Weight",
               {_percent("total_return")} AS "Total Return", {_percent("volatility")} AS "Volatility",
               {_percent("alpha")} AS "Alpha", {_number("beta")} AS "Beta"
        FROM holdings_stats""",
    "total_return_series": rounded(
        f"""(SELECT caldt, {running("ret", order="caldt, action_id")} * 100 AS a,
                    {running("div_ret_0", order="caldt, action_id")} * 100 AS b FROM total_joined)""",
        "caldt",
        "a=cumulative_return b=cumulative_return_bmk",
    ),
    "fund_return_series": rounded(
        f"""(SELECT caldt, fund, {running("ret", "fund", "caldt, action_id")} * 100 AS a,
                    {running("div_ret_0", "fund", "caldt, action_id")} * 100 AS b FROM fund_joined)""",
        "fund caldt",
        "a=cumulative_return b=cumulative_return_bmk",
    ),
    "combined_return_series": rounded(
        f"""(SELECT caldt, fund, {running("ret", "fund")} * 100 AS a FROM fund_series)""",
        "fund caldt",
        "a=cumulative_return",
    ),
    "dividends_by_day": rounded("div_day", "caldt", "amount=dividends"),
    "dividends_by_action": rounded(
        "div_action", "fund ticker action_id caldt", "rate=action_rate amount=action_amount"
    ),
    "dividends_per_fund_day": rounded("div_fund_day", "caldt fund", "amount=dividends"),
    "risk_free_fill": rounded(
        f"""(SELECT d.caldt, d.fund, IFNULL(r.rate, LAG(r.rate) OVER
                    (PARTITION BY d.fund ORDER BY r.caldt ASC NULLS LAST, d.caldt)) AS rf_return
             FROM delta_nav d LEFT JOIN risk_free_rate r USING (caldt)
             WHERE d.caldt BETWEEN {START} AND {END})""",
        "caldt fund",
        "rf_return",
    ),
    "position_snapshot": rounded("pos_avg", "caldt fund ticker side", "shares_1 price_1 fx_rate_1"),
    "net_trades": rounded("trade_net", "caldt fund ticker trade_sign", "net=shares_traded trade_price"),
    "position_trade_merge": rounded(
        "merged",
        _STATE_PLAIN,
        "shares_1 price_1 fx_rate_1 shares_traded trade_price action_rate dividends",
    ),
    "lagged_position_state": rounded("states", _STATE_PLAIN, _STATE_DOUBLES),
    "position_values": rounded("valued", _STATE_PLAIN, _STATE_DOUBLES + " value_0 value_1"),
    "position_returns": rounded(
        "returned",
        "caldt fund ticker action_id side",
        "shares_1 price_1 fx_rate_1 value_1 stock_value weight_after action_rate dividends "
        "ret=return div_ret=div_return",
    ),
    "trading_day_filter": rounded(
        "delta_nav WHERE isodow(caldt) <= 5",
        "caldt fund",
        "starting_value ending_value deposits_withdrawals",
    ),
    "latest_snapshot": rounded("last_positions", "caldt fund ticker asset_class", _POSITION_DOUBLES),
    "benchmark_join": rounded(
        "fund_series f LEFT JOIN (SELECT caldt, ret AS b_ret, div_ret AS b_div, rf_return AS b_rf FROM bmk_series) "
        "USING (caldt)",
        "caldt fund",
        "ret=return xs=xs_return b_ret=return_bmk b_div=div_return b_ret-b_rf=xs_return_bmk "
        "b_div-b_rf=xs_div_return",
    ),
    "published_holding": rounded(_RAISED, "fund ticker horizon_date", "target_price"),
    "published_holding_changes": rounded(
        f"""(SELECT n.*, CASE WHEN h.fund IS NULL THEN 'insert' ELSE 'update' END AS change
            FROM {_RAISED} n LEFT JOIN holding h USING (fund, ticker)
            WHERE h.fund IS NULL OR n.horizon_date <> h.horizon_date OR n.target_price <> h.target_price)""",
        "fund ticker horizon_date change",
        "target_price",
    ),
    "published_portfolio": rounded(
        """(SELECT v.version, p.* FROM portfolio p, (VALUES (0::BIGINT), (1), (2)) v(version)
            WHERE p.fund <> 'grad' OR v.version = 0
            UNION ALL
            SELECT version, 'grad', 0.09::DOUBLE, 0.04::DOUBLE FROM (VALUES (1), (2)) v(version)
            UNION ALL
            SELECT 2, 'omega', 0.07::DOUBLE, NULL)""",
        "version fund",
        "benchmark_return target_tracking_error",
    ),
    "exact_dividends_by_day": rounded(
        """(SELECT caldt, SUM(a::DECIMAL(38, 9))::DOUBLE AS amount
            FROM (SELECT caldt, SUM(gross_amount::DECIMAL(28, 9))::DOUBLE / COUNT(gross_amount) AS a
                  FROM dividends GROUP BY caldt, fund, ticker)
            GROUP BY caldt)""",
        "caldt",
        "amount=dividends",
    ),
    "fund_factor_model": rounded(
        """(SELECT fund, n, my - b1 * m1 - b2 * m2 AS intercept, b1, b2, (b1 * s1y + b2 * s2y) / syy AS r
            FROM (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2
                  FROM (SELECT fund, COUNT(*) AS n, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2, var_pop(y) AS syy,
                               var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
                               covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y
                        FROM (SELECT fund, xs AS y, xs_bmk AS x1, dividends / NULLIF(starting_value, 0) AS x2
                              FROM fund_joined)
                        WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY fund)))""",
        "fund n",
        "intercept b1=beta_xs_return_bmk b2=beta_payout r=r_squared",
        8,
    ),
    "carried_holding_state": rounded(
        """(SELECT * FROM merged WHERE caldt <= DATE '2001-05-31'
            QUALIFY row_number() OVER (PARTITION BY fund, ticker ORDER BY caldt DESC, action_id DESC) = 1)""",
        "fund ticker caldt action_id side",
        "shares_1 price_1 fx_rate_1",
    ),
    "op_volatility": f"SELECT fund, {six(annual_std('ret'), 10)} AS volatility FROM fund_series GROUP BY fund",
    "op_tracking_error": f"""
        SELECT fund, {six(annual_std("xs - xs_div"), 10)} AS tracking_error FROM fund_joined GROUP BY fund""",
    "op_expected_return": f"""
        SELECT fund, {six("AVG(xs) * 252", 10)} AS expected_return FROM fund_series GROUP BY fund""",
    "op_ols_beta_alpha": rounded(
        f"""(SELECT fund, {finite("regr_slope(xs, xs_bmk)")} AS beta,
                    {finite("regr_intercept(xs, xs_bmk)")} AS alpha FROM fund_joined GROUP BY fund)""",
        "fund",
        "beta alpha",
        10,
    ),
    "op_sharpe_ratio": rounded("fund_stats", "fund", "sharpe_ratio", 10),
    "op_information_ratio": rounded("fund_stats", "fund", "information_ratio", 10),
    "op_period_alpha": rounded("fund_stats", "fund", "alpha", 10),
    "op_cumulative_return": rounded(
        f"""(SELECT caldt, fund, ret, {running("ret", "fund")} AS cum FROM fund_series)""",
        "fund caldt",
        "ret=return cum=total_return",
    ),
    "op_lag_state": rounded(
        "lags",
        "caldt fund ticker action_id previous_side",
        "previous_shares previous_price previous_fx_rate",
    ),
}

def within(body: str, start: str, end: str) -> str:
    """The statement of a body over another window."""
    return statement(body).replace(START, f"DATE '{start}'").replace(END, f"DATE '{end}'")


_MONTH = within(_BODIES["all_holdings_daily_returns"], "2001-06-01", "2001-06-29")
_CUT = ("1996-02-14", "2000-09-20")
_FUND_MONEY = (_ALL_MEASURES + " total_return_bmk").replace("dividends", _MONEY)

ORACLES: dict[str, str] = {name: statement(body) for name, body in _BODIES.items()} | {
    "carried_holding_returns": _MONTH,
    "carried_after_correction": _MONTH,
    "sliced_lag_state": statement(_BODIES["op_lag_state"]),
    "scanned_total_return_series": statement(_BODIES["total_return_series"]),
    "laid_out_holding_returns": statement(_BODIES["all_holdings_daily_returns"]),
    "laid_out_latest_snapshot": statement(_BODIES["latest_snapshot"]),
    "laid_out_holdings_performance": statement(_BODIES["holdings_performance"]),
    "stored_fund_performance": statement(rounded("fund_stats", "fund", _FUND_MONEY, 10)),
    "stored_total_performance": within(
        rounded("total_stats", "", _ALL_MEASURES.replace("dividends", _MONEY), 10), *_CUT
    ),
    "stored_performance_report": within(_BODIES["performance_report"], *_CUT),
}
