"""Reading the domain tables from files or over JDBC."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from fundperf.functions.bounds import as_date
from fundperf.sources.schemas import SCHEMAS, conform
from fundperf.sources.versions import VersionedTable, is_versioned


class Tables(Mapping):
    """Named tables, each built on first use."""

    def __init__(self, names, build: Callable[[str], DataFrame]):
        self._names = tuple(names)
        self._build = build
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def load_table(
    spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """One domain table from any Spark source, conformed to its declared schema."""
    reader = spark.read.format(fmt).options(**options)
    return conform(reader.load(path) if path else reader.load(), name)


def parquet_tables(spark: SparkSession, root: str) -> Tables:
    """All domain tables as ``<root>/<table>`` Parquet folders or ``.parquet`` files, not both of one table.

    A folder of published versions is read at the latest one.
    """

    def build(name: str) -> DataFrame:
        if is_versioned(spark, f"{root.rstrip('/')}/{name}"):
            return conform(VersionedTable(spark, f"{root.rstrip('/')}/{name}").read(), name)
        pattern = f"{root.rstrip('/')}/{name}{{,.parquet}}"
        found = _matches(spark, pattern)
        if len(found) > 1:
            raise ValueError(f"{name}: several tables of this name, {' and '.join(found)}")
        return load_table(spark, name, pattern)

    return Tables(SCHEMAS, build)


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of any file system that a pattern matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def jdbc_settings(settings: Mapping[str, str] | None = None) -> dict[str, str]:
    """JDBC options from connection settings, by default the process environment.

    The five ``DB_`` names are fixed values. The password travels as an option of its own, never inside the URL.
    """
    values = os.environ if settings is None else settings
    return {
        "url": f"jdbc:postgresql://{values['DB_ENDPOINT']}:{values['DB_PORT']}/{values['DB_NAME']}",
        "user": values["DB_USER"],
        "password": values["DB_PASSWORD"],
        "driver": "org.postgresql.Driver",
    }


def jdbc_partitioning(
    start: str | date, end: str | date, partitions: int, column: str = "caldt"
) -> dict[str, str]:
    """Options that split a dated table into parallel range reads.

    The bounds only place the cuts: rows outside them are read by the outer partitions. So they must be
    those of the table's whole history, not of a report's window.
    """
    return {
        "partitionColumn": column,
        "lowerBound": as_date(start).isoformat(),
        "upperBound": as_date(end).isoformat(),
        "numPartitions": str(partitions),
    }


def table_days(
    spark: SparkSession, name: str, connection: Mapping[str, str]
) -> tuple[date | None, date | None]:
    """First and last day of a table, asked of the database."""
    query = f"SELECT min(caldt) AS first, max(caldt) AS last FROM {name}"
    row = spark.read.format("jdbc").options(**connection, query=query).load().first()
    return row["first"], row["last"]


def table_histogram(spark: SparkSession, name: str, connection: Mapping[str, str]) -> list[tuple[date, int]]:
    """Rows of a table by day, in order of days, asked of the database: a row for each day."""
    query = f"SELECT caldt, count(*) AS n FROM {name} WHERE caldt IS NOT NULL GROUP BY caldt"
    rows = spark.read.format("jdbc").options(**connection, query=query).load().collect()
    return sorted((as_date(row["caldt"]), int(row["n"])) for row in rows)


def equal_ranges(histogram: list[tuple[date, int]], partitions: int, column: str = "caldt") -> list[str]:
    """Conditions that split a table into at most ``partitions`` ranges of days with about as many rows each.

    A day is never split, so a day with more rows than a range's share is a range of its own. Together they hold every
    row once: days beyond the histogram fall into the outer ranges, rows without a day into the first.
    """
    total, seen, cuts = sum(n for _, n in histogram), 0, []
    for day, n in histogram:
        # A range ends before the day that would take it further beyond its share than it is short of it.
        share = total * (len(cuts) + 1) / partitions
        if seen and len(cuts) + 1 < partitions and seen + n / 2 >= share:
            cuts.append(day.isoformat())
        seen += n
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= DATE '{a}' AND {column} < DATE '{b}'" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < DATE '{cuts[0]}' OR {column} IS NULL", *inner, f"{column} >= DATE '{cuts[-1]}'"]


def jdbc_tables(
    spark: SparkSession,
    settings: Mapping[str, str] | None = None,
    partitions: int | None = None,
    history: tuple[str | date, str | date] | None = None,
    fetchsize: int = 10_000,
    balanced: bool = False,
) -> Tables:
    """All domain tables over JDBC; dated tables are read in ``partitions`` parallel ranges if asked.

    The ranges span ``history``, or the first to the last day of each table, which one row of a query tells. If
    ``balanced``, they hold about as many rows each instead, by a count of each table's rows by day.
    """
    connection = jdbc_settings(settings) | {"fetchsize": str(fetchsize)}

    def build(name: str) -> DataFrame:
        ranges = {}
        if partitions and balanced and "caldt" in SCHEMAS[name].names:
            properties = {key: value for key, value in connection.items() if key != "url"}
            conditions = equal_ranges(table_histogram(spark, name, connection), partitions)
            return conform(spark.read.jdbc(connection["url"], name, predicates=conditions, properties=properties), name)
        if partitions and "caldt" in SCHEMAS[name].names:
            first, last = history or table_days(spark, name, connection)
            if first is not None:
                ranges = jdbc_partitioning(first, last, partitions)
        return load_table(spark, name, fmt="jdbc", dbtable=name, **connection, **ranges)

    return Tables(SCHEMAS, build)
