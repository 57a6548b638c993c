"""Sharding: a Feistel permutation of global row numbers gives a reproducible shuffle.

Row i of n goes to position p = permute(i), and from there to shard p mod S, slot p div S. Shard sizes
differ by one row at most, slots have no gaps, and shard and slot of any row number can be computed
without data (``locate``); ``row_at`` is the inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import splitmix, table, with_row_number

SHARDS = 24
SEED = 20240601
ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, half: int, seed: int, backwards: bool) -> np.ndarray:
    """One Feistel network over 2 * half bits."""
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))
        if backwards:
            left, right = right ^ (splitmix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (splitmix(right ^ key) & mask)
    return (left << shift) | right


def permute(index: np.ndarray, n: int, seed: int = SEED, backwards: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse); values outside walk on along their cycle until inside."""
    half = _half_bits(n)
    out = _rounds(np.asarray(index).astype(np.uint64), half, seed, backwards)
    outside = np.flatnonzero(out >= n)
    while outside.size:
        out[outside] = _rounds(out[outside], half, seed, backwards)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def locate(row: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    position = permute(row, n, seed)
    return position % shards, position // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number at a shard's slot."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, backwards=True)


def shuffle_shards(
    df: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``df`` with row_number, shard and slot.

    ``key`` orders the rows and should tell them apart; rows that agree in it get neighbouring numbers in
    any order. Nulls in key columns are values like others; an empty table gives an empty result. Columns
    of ``df`` named row_number, shard or slot give way to the new ones, but may be part of the key; others keep any name.
    """
    numbered, n = with_row_number(df, key, "row_number")
    schema = StructType(
        [*numbered.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = locate(batch["row_number"].to_numpy(), n, shards, seed)
            yield batch.append_column("shard", pa.array(shard, pa.int32())).append_column(
                "slot", pa.array(slot, pa.int64())
            )

    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in ("row_number", "shard", "slot")]
    return numbered.mapInArrow(place, schema).select(*kept, "row_number", "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the ``rows`` law.

    Null texts have size 8 and the checksum of an empty text. Equal rows share no slot; which of them gets
    which of their slots doesn't show, as they are equal. Further columns aren't read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffle_shards(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
