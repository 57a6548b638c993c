"""The domain tables as views over the TPC-H-like test tables (see FIXTURES.md).

Every source row counts: no key is filtered out, and tickers multiply with the parts and
customers. Lines are booked weekly, each fund on its own weekday, so funds end on different days. All measures are integers or binary fractions, so sums and averages are exact in
any order and two engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundperf.sources.readers import Tables
from fundperf.sources.schemas import SCHEMAS

# Horizons count from here.
HORIZON = "DATE'2001-12-31'"
# Days count from here in the market's move.
FIRST_DAY = "DATE'1995-01-01'"

# Columns used of the source tables, declared so that reading needs no inference job.
SOURCES = {
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "orders": (
        "o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "part": "p_partkey BIGINT, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _day(ts: str) -> str:
    return f"CAST({ts} AS DATE)"


def _booking_day(ts: str, key: str) -> str:
    """The fund's last booking day up to ``ts``: Mondays, for undergrad Tuesdays, for quant Thursdays."""
    shift = f"CASE {key} % 4 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 0 END"
    return f"date_sub({_day(ts)}, pmod(weekday({_day(ts)}) - ({shift}), 7))"


def _market(day: str, back: int = 0) -> str:
    """A level between -50 and 50 that only the day decides, which benchmark and funds share."""
    return f"((datediff({day}, {FIRST_DAY}) + {1000 - back}) * 37 % 101 - 50)"


def _fund(key: str) -> str:
    return (
        f"CASE {key} % 4 WHEN 0 THEN 'grad' WHEN 1 THEN 'undergrad' "
        "WHEN 2 THEN 'brigham_capital' ELSE 'quant' END"
    )


def _bucket(key: str) -> str:
    return f"({key} DIV 10)"


def _ticker(key: str) -> str:
    bucket = _bucket(key)
    return f"CASE {bucket} WHEN 0 THEN 'IWV' WHEN 1 THEN 'VMFXX' ELSE concat('T', {bucket}) END"


def _cents(amount: str) -> str:
    return f"CAST(rint({amount} * 100) AS BIGINT)"


def _price(key: str, amount: str) -> str:
    return f"100 + ({_bucket(key)} % 12) * 5 + ({_cents(amount)} % 200) / 64"


class _Source:
    def __init__(self, spark: SparkSession, sf_dir: str):
        def read(name: str) -> DataFrame:
            return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

        self._raw = Tables(SOURCES, read)

    def _order_cents(self, *keys: str) -> DataFrame:
        cents = self._raw["orders"].selectExpr(*keys, f"{_cents('o_totalprice')} AS cents")
        names = [name for name in cents.columns if name != "cents"]
        return cents.groupBy(*names).agg(F.sum("cents").alias("s"))

    def _fund_day(self) -> DataFrame:
        return self._order_cents(f"{_day('o_orderdate')} AS caldt", f"{_fund('o_custkey')} AS fund")

    def _booked(self) -> DataFrame:
        days, fund = _booking_day("l_shipdate", "l_suppkey"), _fund("l_suppkey")
        cents = self._raw["lineitem"].selectExpr(
            f"{days} AS caldt", f"{fund} AS fund", f"{_cents('l_extendedprice')} AS cents"
        )
        return cents.groupBy("caldt", "fund").agg(F.sum("cents").alias("s"))

    def _daily(self) -> DataFrame:
        return self._order_cents(f"{_day('o_orderdate')} AS caldt")

    def positions(self) -> DataFrame:
        bucket = _bucket("l_partkey")
        return self._raw["lineitem"].selectExpr(
            f"{_booking_day('l_shipdate', 'l_suppkey')} AS caldt",
            f"{_fund('l_suppkey')} AS fund",
            f"{_ticker('l_partkey')} AS ticker",
            f"CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'OPT' "
            f"WHEN {bucket} = 1 THEN 'CASH' ELSE 'EQ' END AS asset_class",
            f"(CASE WHEN {bucket} % 12 = 3 THEN -1 ELSE 1 END) * (100 + l_quantity / 8) AS shares",
            f"{_price('l_partkey', 'l_extendedprice')} AS price",
            f"CASE WHEN {bucket} % 12 = 7 THEN (80 + rint(l_discount * 100)) / 64 ELSE 1D END AS fx_rate",
        )

    def trades(self) -> DataFrame:
        return self._raw["orders"].selectExpr(
            f"{_day('o_orderdate')} AS caldt",
            f"{_fund('o_custkey')} AS fund",
            f"{_ticker('o_custkey')} AS ticker",
            f"CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'OPT' "
            f"WHEN {_bucket('o_custkey')} = 1 THEN 'CASH' ELSE 'EQ' END AS asset_class",
            "CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'SELL' ELSE 'SELL (CA.)' END AS buy_sell",
            "CAST((CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END) * (96 + floor(o_totalprice / 20000)) "
            "AS DOUBLE) AS shares_traded",
            f"{_price('o_custkey', 'o_totalprice')} AS price_traded",
        )

    def dividends(self) -> DataFrame:
        day = _booking_day("l_shipdate", "l_suppkey")
        return self._raw["lineitem"].selectExpr(
            f"{day} AS caldt",
            f"{_fund('l_suppkey')} AS fund",
            f"{_ticker('l_partkey')} AS ticker",
            f"CAST((year({day}) * 4 + quarter({day})) * 2 + l_linenumber % 2 AS BIGINT) AS action_id",
            "(10 + rint(l_discount * 100)) / 64 AS gross_rate",
            "(10 + rint(l_discount * 100)) / 4 AS gross_amount",
        )

    def delta_nav(self) -> DataFrame:
        start = "(CASE WHEN s % 97 = 0 THEN 0 ELSE 1000000 + s % 100000 END)"
        flow = "(CASE WHEN s % 11 = 0 THEN 5000 ELSE 0 END)"
        share = "CASE fund WHEN 'grad' THEN 200 WHEN 'undergrad' THEN 250 WHEN 'quant' THEN 350 ELSE 300 END"
        move = f"s % 20001 - 9900 + ({share}) * ({_market('caldt')} - {_market('caldt', 1)})"
        return self._fund_day().selectExpr(
            "caldt",
            "fund",
            f"CAST({start} AS DOUBLE) AS starting_value",
            f"CAST((CASE WHEN s % 89 = 0 THEN {start} ELSE {start} + {move} END) + {flow} AS DOUBLE) "
            "AS ending_value",
            f"CAST({flow} AS DOUBLE) AS deposits_withdrawals",
        )

    def nav(self) -> DataFrame:
        """Stock values on booking days."""
        return self._booked().selectExpr(
            "caldt",
            "fund",
            "CAST(CASE WHEN s % 53 = 0 THEN 0 ELSE 900000 + s % 50000 END AS DOUBLE) AS stock",
        )

    def benchmark(self) -> DataFrame:
        """A level for every day but the public holidays."""
        levels = self._daily().selectExpr("caldt", f"200 + {_market('caldt')} / 16 + (s % 32) / 64 AS ending_value")
        return levels.where("date_format(caldt, 'MM-dd') NOT IN ('01-01', '07-04', '12-25')")

    def risk_free_rate(self) -> DataFrame:
        """A rate for every day but the last of a month."""
        rates = self._daily().selectExpr("caldt", "(100 + s % 100) / 1000000 AS return")
        return rates.where("caldt <> last_day(caldt)")

    def calendar(self) -> DataFrame:
        days = self._raw["orders"].selectExpr(f"{_day('o_orderdate')} AS caldt").distinct()
        return days.where("weekday(caldt) < 5")

    def holding(self) -> DataFrame:
        """Targets from all parts; every second ticker has none."""
        targets = self._raw["part"].selectExpr(
            f"{_fund('p_partkey')} AS fund",
            f"{_ticker('(p_partkey - p_partkey % 20)')} AS ticker",
            f"date_add({HORIZON}, p_size) AS horizon_date",
            "p_retailprice AS target_price",
        )
        return targets.groupBy("fund", "ticker").agg(
            F.max("horizon_date").alias("horizon_date"), F.max("target_price").alias("target_price")
        )

    def portfolio(self) -> DataFrame:
        """Settings of the four funds."""
        owners = self._raw["customer"].selectExpr(f"{_fund('c_custkey')} AS fund", "c_nationkey")
        return owners.groupBy("fund").agg(
            F.expr("(5 + sum(c_nationkey) % 10) / 100 AS benchmark_return"),
            F.expr("(2 + count(1) % 10) / 100 AS target_tracking_error"),
        )

    def logs(self) -> DataFrame:
        return self._raw["events"].selectExpr(
            "CAST(ts AS DATE) AS caldt",
            f"{_fund('user_id')} AS fund",
            "event_id",
            "event_type AS status",
            "value AS elapsed",
        )


def demo_tables(spark: SparkSession, sf_dir: str) -> Tables:
    source = _Source(spark, sf_dir)
    return Tables(SCHEMAS, lambda name: getattr(source, name)())
