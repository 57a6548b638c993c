"""Helpers shared by the corpus operators: tables, byte-bounded batches, shared storage, row numbers."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Text handled at once inside a task; a longer single text is one slice by itself.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one of our own only if none is set."""
    context = spark.sparkContext
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or context.getConf().get(key) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpus-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: lost executors cost no recomputation behind it."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version_of() -> Column:
    """A 128-bit digest of the text, which tells rows that share a doc_id apart."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [value or b"" for value in batch[column].cast(pa.binary()).to_pylist()]


def kept_in_worker(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once in each worker process.

    Tasks get this package by value, so its own globals start anew with every task; a module of its own
    keeps compiled tables for the tasks that follow in the same process.
    """
    name = "fundperf_worker_tables"
    module = sys.modules.setdefault(name, ModuleType(name))
    kept = module.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def arrow_schema(ddl: str) -> pa.Schema:
    """A pyarrow schema from ``name type`` pairs of the few types used here."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()),
    }
    pairs = [part.split() for part in ddl.split(", ")]
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


def splitmix(x: np.ndarray) -> np.ndarray:
    """A mixing bijection of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Buckets for numbering rows; also the size bound of the broadcast offsets.
NUMBER_BUCKETS = 4096


def with_row_number(df: DataFrame, key: list[str], name: str) -> tuple[DataFrame, int]:
    """(row, ``name``): each row as a struct with a gapless number 0.. that depends on its ``key`` columns alone, and the row count.

    Rows go to hash buckets; bucket counts (at most NUMBER_BUCKETS, on the driver) give each bucket its
    first number, and a window numbers the rows of a bucket by hash and key. Rows that agree in the whole
    key are interchangeable.
    """
    from pyspark.sql import Window

    digest = F.xxhash64(*[f"row.`{column}`" for column in key])
    bucket = F.pmod(F.col("digest"), F.lit(NUMBER_BUCKETS)).cast("int")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).withColumn("digest", digest)
    keyed = keyed.withColumn("bucket", bucket)
    counts = {r["bucket"]: r["count"] for r in keyed.groupBy("bucket").count().collect()}
    starts, total = [], 0
    for b in sorted(counts):
        starts.append((b, total))
        total += counts[b]
    first = df.sparkSession.createDataFrame(starts, "bucket int, first long")
    within = Window.partitionBy("bucket").orderBy("digest", *[f"row.`{column}`" for column in key])
    numbered = keyed.withColumn("within", F.row_number().over(within) - 1).join(F.broadcast(first), "bucket")
    return numbered.select("row", (F.col("first") + F.col("within")).alias(name)), total
