"""Tables laid out for plans by holding: folders by month or year, inside them one file per bucket of holdings.

A bucketed table is read with the partitioning that windows and joins by its bucket columns ask for, so these need no
shuffle; conditions on the period drop whole folders. The layout is described in a file of its own beside the rows, so
any session can open the folder. A second small table counts rows by fund and day: it answers which days there are
without opening the rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundperf.constants import HOLDING_KEY
from fundperf.sources.storage import Exists, Folder, stored

DESCRIPTION = "_layout.json"
PERIOD, SHARE = "period", "_share"
#: Rows of a bucket, about, beyond which a table gets more buckets: what one task sorts, writes and reads back.
BUCKET_ROWS = 1_000_000
#: What a folder holds, as the format of its day in Spark and in Python.
PERIODS = {"month": ("yyyy-MM", "%Y-%m"), "year": ("yyyy", "%Y")}


@dataclass(frozen=True)
class LaidOut:
    """Rows by period and bucket, and how many there are by fund and day."""

    rows: DataFrame
    days: DataFrame
    buckets: int
    period: str

    def last_days(self) -> DataFrame:
        """Each fund's last day; reads the counts only."""
        return self.days.groupBy("fund").agg(F.max("caldt").alias("caldt"))

    def period_of(self, column: str) -> Column:
        return F.date_format(column, PERIODS[self.period][0])

    def period_at(self, day: date) -> str:
        return day.strftime(PERIODS[self.period][1])


def _table_name(path: str) -> str:
    return f"layout_{hashlib.md5(path.encode()).hexdigest()}"


def enough_buckets(buckets: int, rows: int) -> int:
    """At least ``buckets``, and so many that a bucket of about ``rows`` rows in all has no more than BUCKET_ROWS."""
    return max(buckets, -(-rows // BUCKET_ROWS))


def write_laid_out(
    rows: DataFrame,
    path: str,
    buckets: int,
    by: Sequence[str] = HOLDING_KEY,
    order: Sequence[str] = ("caldt",),
    period: str = "month",
) -> LaidOut:
    """A new laid-out table below ``path``; a task writes one bucket, a file for each of its periods.

    Rows of one key are one bucket, so a hot key must have been aggregated to a bounded number of rows, such as one per
    day and dividend action. Without ``by`` there are no buckets: each period's rows are dealt evenly to as many files,
    or to more where a file would pass Spark's advisory size of a partition, so no task holds a whole period.
    """
    spark, root = rows.sparkSession, path.rstrip("/")
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period!r}")
    described = {"buckets": buckets, "by": list(by), "order": list(order), "period": period, "schema": rows.schema.jsonValue()}
    try:
        Folder(spark, root).write_new(DESCRIPTION, json.dumps(described, indent=1))
    except Exists:
        raise ValueError(f"{root}: a laid-out table is there already") from None
    _save(rows, root, described, "errorifexists")
    stored(_counts(spark.table(_table_name(root))), f"{root}/days")
    return open_laid_out(spark, root)


def append_laid_out(spark: SparkSession, path: str, rows: DataFrame) -> LaidOut:
    """The table with rows of more days; each period they fall in gets a file per bucket more."""
    root = path.rstrip("/")
    open_laid_out(spark, root)
    described = json.loads(Folder(spark, root).read(DESCRIPTION))
    new = rows.select(*[field["name"] for field in described["schema"]["fields"]])
    _save(new, root, described, "append")
    # Counted from the same rows; the reader adds the counts of a day up.
    _counts(new).write.mode("append").parquet(f"{root}/days")
    return open_laid_out(spark, root)


def open_laid_out(spark: SparkSession, path: str) -> LaidOut:
    """A laid-out table that this or another session wrote."""
    root = path.rstrip("/")
    described = json.loads(Folder(spark, root).read(DESCRIPTION))
    name, by = _table_name(root), described["by"]
    if not spark.catalog.tableExists(name):
        schema = T.StructType.fromJson(described["schema"]).add(PERIOD, T.StringType())
        fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        clusters = f"CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join([*by, *described['order']])}) INTO {described['buckets']} BUCKETS"
        spark.sql(
            f"CREATE TABLE {name} ({fields}) USING parquet OPTIONS (path '{root}/rows') PARTITIONED BY ({PERIOD}) {clusters if by else ''}"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    else:
        spark.catalog.refreshTable(name)
    days = spark.read.parquet(f"{root}/days").groupBy("fund", "caldt").agg(F.sum("rows").alias("rows"))
    return LaidOut(spark.table(name), days, described["buckets"], described["period"])


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fund", "caldt").agg(F.count("*").alias("rows")).repartition(1)


def _save(rows: DataFrame, root: str, described: dict, mode: str) -> None:
    by, buckets = described["by"], described["buckets"]
    dated = rows.withColumn(PERIOD, F.date_format("caldt", PERIODS[described["period"]][0]))
    if by:
        order = [*by, *described["order"]]
        dealt = dated.repartition(buckets, *by).sortWithinPartitions(PERIOD, *order)
        writer = dealt.write.partitionBy(PERIOD).bucketBy(buckets, *by).sortBy(*order)
    else:
        share = F.pmod(F.xxhash64(*rows.columns), F.lit(buckets))
        dealt = dated.withColumn(SHARE, share).hint("rebalance", PERIOD, SHARE).drop(SHARE)
        writer = dealt.sortWithinPartitions(PERIOD, *described["order"]).write.partitionBy(PERIOD)
    writer.mode(mode).option("path", f"{root}/rows").saveAsTable(_table_name(root))
