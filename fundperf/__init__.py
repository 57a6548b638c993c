"""Daily fund and portfolio performance analytics on Spark."""

from fundperf.plans import *  # noqa: F403
from fundperf.plans import __all__ as _plans
from fundperf.sources import (
    demo_tables,
    jdbc_tables,
    parquet_tables,
    write_report,
    write_series,
    write_snapshot,
)

__all__ = [
    *_plans,
    "demo_tables",
    "jdbc_tables",
    "parquet_tables",
    "write_report",
    "write_series",
    "write_snapshot",
]
