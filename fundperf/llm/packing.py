"""Packing by cutting-stock column generation.

Documents become pieces: as many full sequences as they fill, and a remainder. Remainders are the demand of
a cutting-stock problem over their length histogram (lengths rounded up to GRAIN tokens, so the histogram
has at most SEQUENCE / GRAIN classes, whatever the corpus). A linear program over patterns is solved by
column generation: the dual prices of the classes go into a knapsack dynamic program, whose best pattern
enters the basis until none improves it. Patterns are used a whole number of times, rounded down; the rest,
fewer pieces than a few per class, is packed greedily. Pieces are then ranked within their class, and
the ranks are the slots of the patterns.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, kept_in_worker, table, text_slices

SEQUENCE = 1024
GRAIN = 4
END_ID = 0
#: Where the linear program stops: relative distance to its bound, and pricing rounds.
GAP, ROUNDS = 0.001, 600
#: Buckets that pieces of one class are ranked in, and those of the class of full pieces, which grows most.
#: With the classes they bound the counts that are broadcast: some 20,000 rows.
RANK_BUCKETS, FULL_BUCKETS = 64, 4096
SPECIAL = "<|endoftext|>"


class Ids:
    """Token ids of texts as little-endian 32-bit integers.

    ``vocabulary`` is the tokenizers file, ``ranks`` the same vocabulary as ranks, which encodes several
    times as fast. Texts with letters beyond Latin go to the tokenizers library itself, as the two may know
    letters of different Unicode versions.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken

        self.vocabulary = vocabulary
        with open(ranks, "rb") as lines:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        self.foreign = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def part(self, text: str) -> bytes:
        if self.foreign.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        parts = [self.part(part) if part else b"" for part in (text or "").split(SPECIAL)]
        if len(parts) == 1:
            return parts[0]
        return np.array([self.library.token_to_id(SPECIAL)], "<u4").tobytes().join(parts)


def pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document in pieces of at most ``sequence`` ids."""
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    schema = arrow_schema(kind)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept_in_worker(("ids", vocabulary, ranks, pattern), lambda: Ids(vocabulary, ranks, pattern))
        for part in text_slices(batches):
            rows = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                data = ids.of(text) + end
                total = len(data) // 4
                for start in range(0, total, sequence):
                    own = data[4 * start : 4 * (start + sequence)]
                    rows.append((doc_id, start, len(own) // 4, zlib.crc32(own), total))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity the best worth of a multiset of sizes, and the size chosen last."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        fits = fitting[room]
        value[room] = value[room - 1]
        if fits:
            worth = value[room - sizes[:fits]] + prices[:fits]
            k = int(worth.argmax())
            if worth[k] > value[room]:
                value[room], choice[room] = worth[k], k
    return value, choice


def pattern_with(size: int, choice: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The best pattern that holds the given size, as counts."""
    counts, room = np.zeros(len(sizes)), capacity - sizes[size]
    counts[size] = 1
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return counts


def relaxed_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Basis patterns (columns) of the linear program and how often each is used.

    One knapsack prices a pattern around every class; those still worth more than a sequence enter one after
    the other. It ends at the optimum, within GAP of its lower bound, or after ROUNDS knapsacks: every basis
    is a valid packing.
    """
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used, bound = inverse @ demand, demand @ sizes / capacity
    for _ in range(ROUNDS):
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, choice = knapsack(prices, sizes, capacity)
        bound = max(bound, demand @ prices / value[capacity])
        if used.sum() - bound <= GAP * used.sum():
            break
        worth = prices + value[capacity - sizes]
        entered = False
        for k in np.argsort(-worth, kind="stable"):
            if worth[k] <= 1 + 1e-9:
                break
            counts = pattern_with(k, choice, sizes, capacity)
            if inverse.sum(axis=0) @ counts <= 1 + 1e-7:
                continue
            change = inverse @ counts
            ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
            leave = int(np.argmin(ratio))
            if not np.isfinite(ratio[leave]):
                continue
            pivot, times = inverse[leave] / change[leave], ratio[leave]
            inverse = inverse - np.outer(change, pivot)
            inverse[leave] = pivot
            basis[:, leave] = counts
            used = np.maximum(used - times * change, 0)
            used[leave] = times
            entered = True
        if not entered:
            break
    return basis, used


def cutting_plan(demand: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: count}) patterns that hold ``demand[size]`` pieces of each size exactly or with room."""
    sizes = np.flatnonzero(demand)
    plan: list[tuple[int, dict[int, int]]] = []
    rest = demand.astype(np.int64).copy()
    if sizes.size:
        basis, used = relaxed_patterns(sizes, demand[sizes].astype(float), capacity)
        for column, times in zip(basis.T, np.floor(used + 1e-6).astype(np.int64)):
            pattern = {int(s): int(c) for s, c in zip(sizes, column) if c}
            times = min([int(times), *(int(rest[s]) // c for s, c in pattern.items())])
            if times > 0:
                plan.append((times, pattern))
                for s, c in pattern.items():
                    rest[s] -= times * c
    while rest.any():
        pattern, room = {}, capacity
        for s in np.flatnonzero(rest)[::-1].tolist():
            if take := min(room // s, int(rest[s])):
                pattern[s] = take
                room -= take * s
        times = min(int(rest[s]) // c for s, c in pattern.items())
        plan.append((times, pattern))
        for s, c in pattern.items():
            rest[s] -= times * c
    return plan


class Slots:
    """Where the r-th piece of a class goes: its sequence and its place there."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]], classes: int):
        first = np.cumsum([0, *(times for times, _ in plan)])
        self.ends, self.starts, self.counts, self.shift = [], [], [], []
        for size in range(classes + 1):
            rows = [
                (times * p[size], int(first[k]), p[size], sum(c for s, c in p.items() if s > size))
                for k, (times, p) in enumerate(plan)
                if size in p
            ]
            held, starts, counts, shift = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
            self.ends.append(np.cumsum(held))
            self.starts.append(starts)
            self.counts.append(counts)
            self.shift.append(shift)

    def place(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.ends[size], rank, side="right")
        within = rank - np.concatenate(([0], self.ends[size][:-1]))[k]
        count = self.counts[size][k]
        return self.starts[size][k] + within // count, self.shift[size][k] + within % count


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    sequence: int = SEQUENCE,
    grain: int = GRAIN,
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    Null and empty texts have one id, the end. Equal rows are packed each; a null doc_id stays null. Lengths
    tie freely within a class. Other columns aren't read; an empty table gives an empty result.
    """
    size = F.ceil(F.col("length") / grain).cast("int")
    buckets = F.when(F.col("length") == sequence, FULL_BUCKETS).otherwise(RANK_BUCKETS)
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), buckets).cast("int")
    cutted = cut(pieces(docs, vocabulary, ranks, pattern, sequence).withColumns({"size": size, "bucket": bucket}))
    classes = -(-sequence // grain)
    counts = cutted.groupBy("size", "bucket").count().collect()  # bounded by the buckets
    demand = np.zeros(classes + 1, np.int64)
    first = []
    for row in sorted(counts):
        first.append((row["size"], row["bucket"], int(demand[row["size"]])))
        demand[row["size"]] += row["count"]
    slots = Slots(cutting_plan(demand, classes), classes)
    starts = docs.sparkSession.createDataFrame(first, "size int, bucket int, first long")
    within = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        cutted.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["size", "bucket"])
        .select(*cutted.columns[:5], "size", (F.col("rank") + F.col("first")).alias("rank"))
    )
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    schema = arrow_schema(kind)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            where, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                where[at], place[at] = slots.place(int(s), rank[at])
            yield pa.record_batch([*batch.columns[:5], pa.array(where), pa.array(place)], schema=schema)

    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(assign, kind).select(
        *cutted.columns[:5], "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    )


def pack_public(docs: DataFrame) -> DataFrame:
    """``pack`` with the public byte-level vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path
    return pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack_public(table(spark, sf_dir, "documents"))
