"""Periodic runs by string synchronising sets.

At scale t (a power of two) every stretch of t words has a name, its hash. Position i is synchronising if the least
name among positions i to i + t stands at i or at i + t: a choice that depends on the words there alone, so equal
contexts of 2t words are chosen alike wherever they stand, and about 2/t of all positions are chosen. Positions whose
t words have a period up to t/4 don't count: their names repeat, and would choose everything. They are the insides of
runs that smaller scales have found, so each scale is given the highly periodic regions of those before it; periods
below the first scale are found by comparing the words directly.

A run of period q, t <= q < 2t, of at least 4q words holds a synchronising position in each t of its words, and the next
equal context is exactly q words on. So neighbours among equal contexts, t to 2t words apart, propose all periods; a
proposal is extended both ways by comparing words, and is a run if at least 4q long and of no smaller period. A scale has
time for its positions only, and one document is never more than its own words in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, splitmix, table, text_slices, texts_of
from .substring_dedup import sliding

#: Least repetitions of a run, and its least length in words.
TIMES, LEAST = 4, 6
#: The first scale; smaller periods are compared directly.
FIRST_SCALE = 4
#: Words compared first when a proposal is extended; doubled as long as they agree.
STEP = 64
#: Name of positions that don't count.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


class Codes(dict):
    """A number for every distinct word, so that equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of ``a`` and ``b`` agree from the start on."""
    done, step, size = 0, STEP, min(len(a), len(b))
    while done < size:
        stop = min(size, done + step)
        differ = a[done:stop] != b[done:stop]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = stop, step * 2
    return size


def primitive(codes: np.ndarray, start: int, period: int) -> bool:
    """Whether no divisor of a run's period is a period of it."""
    left, factor = period, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor == 0:
            smaller = period // factor
            if np.array_equal(codes[start : start + period], codes[start + smaller : start + smaller + period]):
                return False
            while left % factor == 0:
                left //= factor
        factor += 1
    return True


def short_periods(codes: np.ndarray) -> list[Run]:
    """Runs of periods below FIRST_SCALE: neighbouring words compared directly."""
    found = []
    for period in range(1, FIRST_SCALE):
        same = np.concatenate(([False], codes[:-period] == codes[period:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in edges.reshape(-1, 2)[np.diff(edges)[::2] >= (TIMES - 1) * period].tolist():
            if primitive(codes, start, period):
                found.append((start, stop - start + period, period))
    return found


def synchronising(names: np.ndarray, scale: int, runs: list[Run]) -> np.ndarray:
    """Synchronising positions at a scale, given the runs of smaller periods."""
    edges = np.zeros(len(names) + 1, np.int32)
    for start, length, period in runs:
        if TIMES * period <= scale <= length:
            edges[start] += 1
            edges[start + length - scale + 1] -= 1
    names = np.where(np.cumsum(edges[:-1]) > 0, NONE, names)
    least = sliding(names, scale + 1, np.minimum)
    return np.flatnonzero(((least == names[:-scale]) | (least == names[scale:])) & (least != NONE))


def proposals(at: np.ndarray, context: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(period, position) wherever the next equal context is one to two scales on."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    apart = np.diff(at)
    hit = (context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale)
    return sorted(zip(apart[hit].tolist(), at[:-1][hit].tolist()))


def extended(codes: np.ndarray, proposed: list[tuple[int, int]]) -> list[Run]:
    """The runs behind proposals in order of period and position."""
    found, last, beyond = [], 0, 0
    for period, at in proposed:
        if period == last and at < beyond:
            continue
        stop = at + agreement(codes[at:], codes[at + period :]) + period
        start = at - agreement(codes[:at][::-1], codes[: at + period][::-1])
        last, beyond = period, stop - period
        if stop - start >= TIMES * period and primitive(codes, start, period):
            found.append((start, stop - start, period))
    return found


def runs_of(documents: list[np.ndarray]) -> list[list[Run]]:
    """(start, length, period) of all runs of each document, by start and period."""
    sizes = np.array([len(own) for own in documents], np.int64)
    # A word of its own follows each document, so nothing repeats across one's end.
    codes = np.concatenate([part for d, own in enumerate(documents) for part in (own, [-1 - d])])
    first = np.cumsum(sizes + 1) - sizes - 1
    found = short_periods(codes)
    chosen, names, scale = np.arange(len(documents)), splitmix(codes + (1 << 62)), 1
    places = first
    while True:
        if scale >= FIRST_SCALE:
            stay = sizes[chosen] >= TIMES * scale
            if not stay.any():
                break
            if not stay.all():
                kept = np.repeat(stay, sizes[chosen] + 1)
                names, chosen = names[kept], chosen[stay]
                places = np.cumsum(sizes[chosen] + 1) - sizes[chosen] - 1
        # Names of twice the length; beyond the end stand words of no document.
        ends = splitmix(np.arange(scale, dtype=np.uint64) + NONE - np.uint64(scale))
        doubled = splitmix(names * GOLDEN + np.concatenate((names[scale:], ends)))
        if scale >= FIRST_SCALE:
            found += at_scale(codes, found, names, doubled, scale, first[chosen], places, sizes[chosen])
        names, scale = doubled, scale * 2
    out: list[list[Run]] = [[] for _ in documents]
    for start, length, period in sorted(found, key=lambda run: (run[0], run[2])):
        if length >= LEAST:
            d = int(np.searchsorted(first, start, side="right")) - 1
            out[d].append((start - int(first[d]), length, period))
    return out


def at_scale(codes, found, names, doubled, scale, first, places, sizes) -> list[Run]:
    """Runs with periods from ``scale`` to twice that, in the documents that stand at ``first`` among all words and at
    ``places`` among the names."""
    within = []
    if found:
        starts = np.array([run[0] for run in found])
        d = np.searchsorted(first, starts, side="right") - 1
        inside = (d >= 0) & (starts < first[d] + sizes[d])
        shift = (places - first)[d]
        within = [(found[k][0] + int(shift[k]), *found[k][1:]) for k in np.flatnonzero(inside).tolist()]
    at = synchronising(names, scale, within)
    d = np.searchsorted(places, at, side="right") - 1
    return extended(codes, proposals(at + (first - places)[d], doubled[at], scale))


def periodic_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, made periodic from some word on where the checksum of the doc_id ends in 0; never without doc_id."""
    n = len(words)
    checksum = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if checksum % 10 or not n:
        return words
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: list[Run]) -> tuple[int | None, int | None, int | None, int | None]:
    """Start, length, period and thousandths of length/period of the run with the greatest of these."""
    if not runs:
        return None, None, None, None
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return *best, 1000 * best[1] // best[2]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what follows the first period of any run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Each row's doc_id, its runs and its text without their repetitions.

    Columns: doc_id, n_words, runs (``start,length,period`` and a line end each, by start and period), n_runs, the
    strongest run's start, length, period and exponent_milli (null without runs), and collapsed, the words that stay,
    joined by single blanks. ``planted`` makes some texts periodic first (see ``periodic_words``). Null and empty texts
    have no words and no runs. Of equally strong runs the first counts, then the one of the smaller period. Repeated rows
    stay rows; a null doc_id is an id like any other; other columns aren't read; an empty table gives an empty
    result. A very long text is handled whole in one task, which holds a few numbers for each of its words.
    """
    kind = (
        "doc_id long, n_words long, runs string, n_runs long, start long, length long, period long, "
        "exponent_milli long, collapsed string"
    )
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            codes, rows = Codes(), []
            ids = part["doc_id"].to_pylist()
            texts = [text.split() for text in texts_of(part)]
            if planted:
                texts = [periodic_words(words, doc_id) for words, doc_id in zip(texts, ids)]
            found = runs_of([codes.of(words) for words in texts])
            for doc_id, words, runs in zip(ids, texts, found):
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                text = b" ".join(kept_words(words, runs)).decode()
                rows.append((doc_id, len(words), listed, len(runs), *strongest(runs), text))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some made periodic first, and digests of the runs and of the collapsed text."""
    return collapse_runs(table(spark, sf_dir, "documents"), planted=True).select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2("runs", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
