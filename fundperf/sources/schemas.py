"""The eleven domain tables: columns, types and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATE, _TEXT, _LONG, _REAL = T.DateType(), T.StringType(), T.LongType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "delta_nav": _schema(
        caldt=_DATE, fund=_TEXT, starting_value=_REAL, ending_value=_REAL, deposits_withdrawals=_REAL
    ),
    "dividends": _schema(
        caldt=_DATE, fund=_TEXT, ticker=_TEXT, action_id=_LONG, gross_rate=_REAL, gross_amount=_REAL
    ),
    "risk_free_rate": _schema(caldt=_DATE, **{"return": _REAL}),
    "positions": _schema(
        caldt=_DATE, fund=_TEXT, ticker=_TEXT, asset_class=_TEXT, shares=_REAL, price=_REAL, fx_rate=_REAL
    ),
    "trades": _schema(
        caldt=_DATE,
        fund=_TEXT,
        ticker=_TEXT,
        asset_class=_TEXT,
        buy_sell=_TEXT,
        shares_traded=_REAL,
        price_traded=_REAL,
    ),
    "nav": _schema(caldt=_DATE, fund=_TEXT, stock=_REAL),
    "calendar": _schema(caldt=_DATE),
    "benchmark": _schema(caldt=_DATE, ending_value=_REAL),
    "logs": _schema(caldt=_DATE, fund=_TEXT),
    "portfolio": _schema(fund=_TEXT, benchmark_return=_REAL, target_tracking_error=_REAL),
    "holding": _schema(fund=_TEXT, ticker=_TEXT, horizon_date=_DATE, target_price=_REAL),
}

# Tables read with all their columns; the rest are narrowed to the schema.
OPEN_TABLES = frozenset({"logs", "portfolio", "holding"})

# Unique keys of the tables that are written by key.
KEYS: dict[str, tuple[str, ...]] = {
    "portfolio": ("fund",),
    "holding": ("fund", "ticker"),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Lower-case names, declared types; a missing column fails at analysis.

    Measures arrive as decimal or double depending on the store. Both become double, so
    that quotients do not take on decimal scales.
    """
    schema = SCHEMAS[table]
    lowered = df.toDF(*[name.lower() for name in df.columns])
    declared = [F.col(field.name).cast(field.dataType).alias(field.name) for field in schema]
    extra = []
    if table in OPEN_TABLES:
        extra = [F.col(name) for name in lowered.columns if name not in schema.names]
    return lowered.select(*declared, *extra)
