"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of any LENGTH consecutive words at least one K-word gram is selected, by its
content alone. Anchors that occur in two documents are extended both ways, to all words that a window of
LENGTH words around the anchor can reach. Occurrences with equal reach repeat as a whole: only the smallest
document of a reach stands for it. Where an anchor has several reaches, the repeats end inside them, and the
standing occurrences are compared window by window, which finds the ends of the maximal repeats. Overlapping
repeated windows then merge into maximal repeats, longer than or equal to LENGTH words, that are removed
from all but the first document. Groups are aggregated, never paired, so a passage that a third of all
documents share costs as many rows as it has occurrences. Equality is that of 128 hash bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_schema, cut, splitmix, table, text_slices, texts_of, version_of

LENGTH = 50
K = 12
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Words a task remembers the hash of.
REMEMBERED = 400_000


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of any run of consecutive words, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE_INVERSE))))
            powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), BASE))))[:n]
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers)))

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return splitmix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` consecutive values."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(values) - width + 1], out[width - done :]) if done < width else out


def anchors(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least of some valid window of ``width`` grams."""
    least = np.where(valid, sliding(grams, width, np.minimum), np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate((pad, least, pad)), width, np.maximum) == grams)


def split_slice(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's first and last word place."""
    parts = [hashes.of(text.split()) for text in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    stops = np.cumsum(counts)
    return np.concatenate(parts), stops - counts, stops


def occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Every anchor with the hash of its reach, its document and its place."""
    kind = "anchor long, reach long, doc_id long, version binary, pos int"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in text_slices(batches):
            words, starts, stops = split_slice(texts_of(part), hashes)
            n = len(words)
            if n < length:
                continue
            rolling = Rolling(words)
            begin = np.arange(n - k + 1)
            grams = rolling.run(begin, begin + k)
            row = np.repeat(np.arange(len(starts)), stops - starts)
            valid = begin[: n - length + 1] + length <= stops[row[: n - length + 1]]
            at = anchors(grams, valid, length - k + 1)
            doc = row[at]
            first = np.maximum(starts[doc], at - (length - k))
            last = np.minimum(stops[doc], at + length)
            shape = ((at - first) * 1024 + (last - at)).astype(np.uint64)
            second = Rolling(splitmix(words + np.uint64(1)))
            reach = splitmix(second.run(first, last) ^ splitmix(shape))
            yield pa.record_batch(
                [
                    pa.array(grams[at].view(np.int64)),
                    pa.array(reach.view(np.int64)),
                    part["doc_id"].cast(pa.int64()).take(pa.array(doc)),
                    part["version"].take(pa.array(doc)),
                    pa.array((at - starts[doc]).astype(np.int32)),
                ],
                schema=schema,
            )

    return docs.mapInArrow(run, kind)


def windows_at(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Hashes of the windows around the listed anchor places ``open`` of each document."""
    kind = "one long, two long, doc_id long, version binary, start int"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in text_slices(batches):
            words, starts, stops = split_slice(texts_of(part), hashes)
            places = part["open"]
            doc = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))
            pos = places.flatten().to_numpy() + starts[doc]
            spread = np.arange(length - k + 1)
            start = (pos[:, None] - spread).ravel()
            doc = np.repeat(doc, len(spread))
            keep = (start >= starts[doc]) & (start + length <= stops[doc])
            start = np.unique(start[keep])
            doc = np.searchsorted(stops, start, side="right")
            one = Rolling(words).run(start, start + length)
            two = Rolling(splitmix(words + np.uint64(1))).run(start, start + length)
            yield pa.record_batch(
                [
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    part["doc_id"].cast(pa.int64()).take(pa.array(doc)),
                    part["version"].take(pa.array(doc)),
                    pa.array((start - starts[doc]).astype(np.int32)),
                ],
                schema=schema,
            )

    return docs.mapInArrow(run, kind)


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, version, starts, stops): overlapping word spans that together are the repeats of a document.

    A span belongs to a document if a smaller doc_id has the same words. ``docs`` has doc_id, text, version.
    """
    known = docs.select("doc_id", "text", "version").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = cut(occurrences(known, length, k))
    # Aggregates are tables of their own before they are joined back: a join that shares an aggregate's
    # shuffle can't have its hot keys split.
    shared = cut(
        found.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("anchor")
    )
    seeds = cut(found.join(shared, "anchor", "left_semi"))
    reaches = cut(seeds.groupBy("anchor", "reach").agg(F.min("doc_id").alias("first_doc")))
    several = reaches.groupBy("anchor").agg((F.count("*") > 1).alias("several")).filter("several")
    judged = cut(
        seeds.join(reaches.join(cut(several), "anchor", "left"), ["anchor", "reach"])
        .filter("doc_id > first_doc OR several")
        .select("doc_id", "version", "pos", (F.col("doc_id") > F.col("first_doc")).alias("whole"))
    )
    open_ = judged.filter("NOT whole").groupBy("doc_id", "version").agg(F.collect_set("pos").alias("open"))
    windows = cut(windows_at(known.join(open_, ["doc_id", "version"]), length, k))
    first = cut(windows.groupBy("one", "two").agg(F.min("doc_id").alias("first_doc")))
    single = windows.join(first, ["one", "two"]).filter("doc_id > first_doc")
    # An anchor's reach may pass the document's ends; spans are clipped where they are used.
    spans = judged.filter("whole").select(
        "doc_id", "version", (F.col("pos") - (length - k)).alias("start"), (F.col("pos") + length).alias("stop")
    ).unionAll(single.select("doc_id", "version", "start", F.col("start") + length))
    return spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(
        "doc_id", "version", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")
    )


def removed_words(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n words the spans cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(stops, 0, n), -1)
    return np.cumsum(change[:-1]) > 0


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(others, text, n_words, n_removed, kept_sha256) of every row.

    ``others`` holds all other columns, whatever their names; text has the words that stay. Untouched texts
    stay as they are; others keep their remaining words, joined by one space. Null texts have no words and
    stay null. A null doc_id is neither smaller nor larger than another: such rows stay as they are. Rows
    that share a doc_id are judged each by its own text, and not against one another. An empty table gives
    an empty result.
    """
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    rows = docs.select("doc_id", "text", version_of().alias("version"), F.struct(*others).alias("others"))
    joined = rows.join(repeats(rows, length, k), ["doc_id", "version"], "left")
    kind = StructType(
        [
            joined.schema["others"],
            StructField("text", StringType()),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept_sha256", StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = []
            for text, shown, starts, stops in zip(
                texts_of(part), part["text"].to_pylist(), part["starts"].to_pylist(), part["stops"].to_pylist()
            ):
                kept = words = text.split()
                if starts:
                    gone = removed_words(len(words), np.array(starts), np.array(stops))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                if starts:
                    shown = joined.decode()
                rows.append((shown, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
            texts, n_words, n_removed, digests = zip(*rows)
            columns = [
                part["others"],
                pa.array(texts, pa.string()),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(digests, pa.string()),
            ]
            yield pa.record_batch(columns, names=kind.names)

    return joined.select("others", "text", "starts", "stops").mapInArrow(run, kind)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 50-word windows leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("others.doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT rid, doc_id, i, array_to_string(words[i : i + 49], ' ') AS window_words
    FROM texts, unnest(range(1, len(words) - 48)) AS u(i)
), firsts AS (
    SELECT window_words, min(doc_id) AS first_doc FROM windows GROUP BY window_words
), removed AS (
    SELECT DISTINCT rid, i + k AS place
    FROM windows JOIN firsts USING (window_words), unnest(range(50)) AS u(k)
    WHERE doc_id > first_doc
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY place) AS kept_words, count(*) AS n
    FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts)
        ANTI JOIN removed USING (rid, place)
    GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept_words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""
