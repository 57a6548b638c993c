"""Keyed tables published version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundperf.plans.returns import TablesLike
from fundperf.sources.schemas import KEYS, SCHEMAS
from fundperf.sources.versions import StaleVersion, Version, VersionedTable


def publish_table(
    spark: SparkSession, tables: TablesLike, name: str, root: str, files: int | None = None
) -> VersionedTable:
    """The first version of a keyed table below ``<root>/<name>``, where ``parquet_tables`` finds its latest one."""
    table = VersionedTable(spark, f"{root.rstrip('/')}/{name}")
    table.create(tables[name], KEYS[name], files)
    return table


def publish_upsert(
    table: VersionedTable,
    name: str,
    updates: DataFrame,
    row_bound: int | None = None,
    batch: str | None = None,
    base: Version | None = None,
    attempts: int = 5,
) -> Version:
    """Publish a batch of settings or targets.

    Where another writer was first, the batch is applied again to what that one published, ``attempts`` times in all.
    A batch with a name is applied once, however often it is sent.
    """
    set_cols = [column for column in SCHEMAS[name].names if column not in KEYS[name]]
    for attempt in range(attempts):
        try:
            return table.upsert(updates, set_cols, row_bound, base if attempt == 0 else None, batch)
        except StaleVersion:
            if attempt == attempts - 1:
                raise
    raise ValueError("at least one attempt is needed")
