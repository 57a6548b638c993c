"""The domain tables in DuckDB SQL (see FIXTURES.md)."""

from __future__ import annotations

HORIZON, FIRST_DAY = "DATE '2001-12-31'", "DATE '1995-01-01'"


def _day(ts: str) -> str:
    return f"CAST({ts} AS DATE)"


def _booked(ts: str, key: str) -> str:
    start = f"CASE {key} % 4 WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 1 END"
    return f"({_day(ts)} - CAST((isodow({_day(ts)}) - ({start}) + 7) % 7 AS INTEGER))"


def _market(days: str) -> str:
    return f"(({days}) * 37 % 101 - 50)"


_DAYS = f"(caldt - {FIRST_DAY}) + 1000"


def _fund(key: str) -> str:
    return f"CASE {key} % 4 WHEN 0 THEN 'grad' WHEN 1 THEN 'undergrad' WHEN 2 THEN 'brigham_capital' ELSE 'quant' END"


def _bucket(key: str) -> str:
    return f"({key} // 10)"


def _ticker(key: str) -> str:
    return f"CASE {_bucket(key)} WHEN 0 THEN 'IWV' WHEN 1 THEN 'VMFXX' ELSE 'T' || {_bucket(key)} END"


def _cents(amount: str) -> str:
    return f"CAST(ROUND({amount} * 100) AS BIGINT)"


def _price(key: str, amount: str) -> str:
    return f"100 + ({_bucket(key)} % 12) * 5 + ({_cents(amount)} % 200) / 64"


def _points(fraction: str) -> str:
    return f"ROUND({fraction} * 100)"


VIEWS: dict[str, str] = {
    "positions": f"""
        SELECT {_booked("l_shipdate", "l_suppkey")} AS caldt, {_fund("l_suppkey")} AS fund,
               {_ticker("l_partkey")} AS ticker,
               CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'OPT'
                    WHEN {_bucket("l_partkey")} = 1 THEN 'CASH' ELSE 'EQ' END AS asset_class,
               CASE WHEN {_bucket("l_partkey")} % 12 = 3 THEN -1 ELSE 1 END * (100 + l_quantity / 8) AS shares,
               {_price("l_partkey", "l_extendedprice")} AS price,
               CASE WHEN {_bucket("l_partkey")} % 12 = 7 THEN (80 + {_points("l_discount")}) / 64
                    ELSE 1.0::DOUBLE END AS fx_rate
        FROM lineitem""",
    "trades": f"""
        SELECT {_day("o_orderdate")} AS caldt, {_fund("o_custkey")} AS fund, {_ticker("o_custkey")} AS ticker,
               CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'OPT'
                    WHEN {_bucket("o_custkey")} = 1 THEN 'CASH' ELSE 'EQ' END AS asset_class,
               CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'SELL' ELSE 'SELL (CA.)' END AS buy_sell,
               CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END * (96 + FLOOR(o_totalprice / 20000))
                   AS shares_traded,
               {_price("o_custkey", "o_totalprice")} AS price_traded
        FROM orders""",
    "dividends": f"""
        SELECT caldt, fund, ticker, (year(caldt) * 4 + quarter(caldt)) * 2 + l_linenumber % 2 AS action_id,
               (10 + {_points("l_discount")}) / 64 AS gross_rate,
               (10 + {_points("l_discount")}) / 4 AS gross_amount
        FROM (SELECT {_booked("l_shipdate", "l_suppkey")} AS caldt, {_fund("l_suppkey")} AS fund,
                     {_ticker("l_partkey")} AS ticker, l_linenumber, l_discount
              FROM lineitem)""",
    "fund_cents": f"""
        SELECT {_day("o_orderdate")} AS caldt, {_fund("o_custkey")} AS fund,
               CAST(SUM({_cents("o_totalprice")}) AS BIGINT) AS s
        FROM orders GROUP BY 1, 2""",
    "day_cents": """
        SELECT caldt, CAST(SUM(s) AS BIGINT) AS s FROM fund_cents GROUP BY caldt""",
    "delta_nav": f"""
        SELECT caldt, fund, sv::DOUBLE AS starting_value,
               (CASE WHEN s % 89 = 0 THEN sv
                     ELSE sv + s % 20001 - 9900 + beta * ({_market(_DAYS)} - {_market(_DAYS + " - 1")}) END
                + dw)::DOUBLE AS ending_value,
               dw::DOUBLE AS deposits_withdrawals
        FROM (SELECT *, CASE WHEN s % 97 = 0 THEN 0 ELSE 1000000 + s % 100000 END AS sv,
                     CASE WHEN s % 11 = 0 THEN 5000 ELSE 0 END AS dw,
                     CASE fund WHEN 'grad' THEN 200 WHEN 'undergrad' THEN 250 WHEN 'quant' THEN 350
                               ELSE 300 END AS beta
              FROM fund_cents)""",
    "nav": f"""
        SELECT caldt, fund, (CASE WHEN s % 53 = 0 THEN 0 ELSE 900000 + s % 50000 END)::DOUBLE AS stock
        FROM (SELECT {_booked("l_shipdate", "l_suppkey")} AS caldt, {_fund("l_suppkey")} AS fund,
                     CAST(SUM({_cents("l_extendedprice")}) AS BIGINT) AS s
              FROM lineitem GROUP BY 1, 2)""",
    "bmk": f"""
        SELECT caldt, 200 + {_market(_DAYS)} / 16 + (s % 32) / 64 AS ending_value FROM day_cents
        WHERE strftime(caldt, '%m-%d') NOT IN ('01-01', '07-04', '12-25')""",
    "risk_free_rate": """
        SELECT caldt, (100 + s % 100) / 1000000 AS rate FROM day_cents WHERE caldt <> last_day(caldt)""",
    "calendar": """
        SELECT caldt FROM day_cents WHERE isodow(caldt) <= 5""",
    "holding": f"""
        SELECT {_fund("p_partkey")} AS fund, {_ticker("(p_partkey - p_partkey % 20)")} AS ticker,
               MAX(CAST({HORIZON} + p_size AS DATE)) AS horizon_date, MAX(p_retailprice) AS target_price
        FROM part GROUP BY 1, 2""",
    "portfolio": f"""
        SELECT {_fund("c_custkey")} AS fund, (5 + CAST(SUM(c_nationkey) AS BIGINT) % 10) / 100 AS benchmark_return,
               (2 + COUNT(*) % 10) / 100 AS target_tracking_error
        FROM customer GROUP BY 1""",
    "logs": f"""
        SELECT CAST(ts AS DATE) AS caldt, {_fund("user_id")} AS fund, event_id,
               event_type AS status, value AS elapsed
        FROM events""",
}
