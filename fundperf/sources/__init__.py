from fundperf.sources.demo import demo_tables
from fundperf.sources.layout import LaidOut, append_laid_out, open_laid_out, write_laid_out
from fundperf.sources.readers import (
    Tables,
    equal_ranges,
    jdbc_partitioning,
    jdbc_settings,
    jdbc_tables,
    load_table,
    parquet_tables,
)
from fundperf.sources.schemas import KEYS, SCHEMAS, conform
from fundperf.sources.sinks import write_report, write_series, write_snapshot
from fundperf.sources.storage import shared_folder, stored
from fundperf.sources.versions import DataFile, StaleVersion, Version, VersionedTable, is_versioned

__all__ = [
    "DataFile",
    "KEYS",
    "LaidOut",
    "SCHEMAS",
    "StaleVersion",
    "Tables",
    "Version",
    "VersionedTable",
    "append_laid_out",
    "conform",
    "demo_tables",
    "equal_ranges",
    "is_versioned",
    "jdbc_partitioning",
    "jdbc_settings",
    "jdbc_tables",
    "load_table",
    "open_laid_out",
    "parquet_tables",
    "shared_folder",
    "stored",
    "write_laid_out",
    "write_report",
    "write_series",
    "write_snapshot",
]
