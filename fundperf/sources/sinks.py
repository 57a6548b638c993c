"""Writing reports, series and snapshots.

Every sink writes a folder of its own and by default refuses one that exists, so no job can
overwrite what it is still reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: str | None = None,
) -> None:
    """A report as files, on request with one folder per value of a column."""
    options = {"header": "true"} if fmt == "csv" else {}
    writer = df.write.format(fmt).options(**options).mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def write_series(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long daily series, one folder per fund where the series has funds."""
    writer = df.write.mode(mode)
    if "fund" in df.columns:
        writer = writer.partitionBy("fund")
    writer.parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """New version of a keyed table; the caller points readers at it afterwards."""
    df.write.mode("errorifexists").parquet(path)
