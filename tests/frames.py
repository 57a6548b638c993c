"""Hand-made domain tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from fundperf.sources import SCHEMAS, Tables


def day(text: str) -> date:
    return date.fromisoformat(text)


def make_tables(spark: SparkSession, **rows: list[tuple]) -> Tables:
    """Tables from tuples in schema order; days may be ISO strings."""

    def build(name: str):
        schema = SCHEMAS[name]
        dated = [isinstance(field.dataType, T.DateType) for field in schema]
        data = [
            tuple(day(v) if is_day and isinstance(v, str) else v for v, is_day in zip(row, dated))
            for row in rows.get(name, [])
        ]
        return spark.createDataFrame(data, schema)

    return Tables(SCHEMAS, build)


def rows_of(df, *columns: str, by: tuple[str, ...] | None = None) -> list[tuple]:
    """Rows as tuples, sorted by the given columns or by all of them."""
    names = list(columns) or df.columns
    picked = [tuple(row[name] for name in names) for row in df.collect()]
    order = [names.index(name) for name in by] if by else range(len(names))
    return sorted(picked, key=lambda row: tuple((row[i] is not None, str(row[i])) for i in order))
