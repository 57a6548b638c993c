"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measures of the whole text, cut into quantile bins. Boosting goes round the features in turn,
fits a shallow tree to one feature at a time and adds it to that feature's lookup table; afterwards it goes
round the feature pairs on which the residuals vary most. A score is the sum of one table entry per
feature and per pair, so documents are scored in batches by additions over their bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, table, text_slices, texts_of

#: Labelled rows the model is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 120, 40, 0.15, 4, 4.0

FEATURES = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "symbols",
    "signs",
    "exclamations",
    "upper",
    "digits",
    "beyond_ascii",
    "spaces",
    "distinct_words",
    "top_word",
    "same_as_previous",
    "line_words",
    "repeated_lines",
    "short_words",
)


def _ranges(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


SYMBOLS, SIGNS = _ranges(b"#*$%&|<>"), _ranges(b"!\"'(),-./:;?@[\\]^_`{}~+=")
EMPTY = (0.0,) * len(FEATURES)


def features(text: bytes) -> tuple[float, ...]:
    """The measures of one text; zeros without words."""
    words = text.split()
    if not words:
        return EMPTY
    size, n = len(text), len(words)
    found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        float(np.log(size)),
        float(np.log(n)),
        sum(map(len, words)) / n,
        found[SYMBOLS].sum() / size,
        found[SIGNS].sum() / size,
        found[0x21] / size,
        found[0x41:0x5B].sum() / size,
        found[0x30:0x3A].sum() / size,
        found[0x80:].sum() / size,
        (found[0x20] + found[0x09 : 0x0E].sum()) / size,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        float(np.log(n / len(lines))),
        (len(lines) - len(set(lines))) / len(lines),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
    )


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(text) for text in texts], np.float64).reshape(-1, len(FEATURES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def leaf(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient / (weight + RIDGE)


def tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of at most LEAVES leaves over one feature's bins: the value it adds to each bin."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    bounds = [0, len(gradient)]

    def best(low: int, high: int) -> tuple[float, int]:
        cuts = np.arange(low + 1, high)
        if not cuts.size:
            return 0.0, 0
        left, right = (g[cuts] - g[low], h[cuts] - h[low]), (g[high] - g[cuts], h[high] - h[cuts])
        gain = left[0] * leaf(*left) + right[0] * leaf(*right)
        k = int(np.argmax(gain))
        whole = g[high] - g[low]
        return float(gain[k] - whole * leaf(whole, h[high] - h[low])), int(cuts[k])

    while len(bounds) <= LEAVES:
        gain, cut_ = max(best(a, b) for a, b in zip(bounds, bounds[1:]))
        if gain <= 1e-9:
            break
        bounds = sorted([*bounds, cut_])
    out = np.empty(len(gradient))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = leaf(g[b] - g[a], h[b] - h[a])
    return out


def cross_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on each axis of a pair's bins: the gain, and the value added to each cell."""
    n = len(gradient)

    def corners(cells: np.ndarray) -> np.ndarray:
        sums = cells.cumsum(0).cumsum(1)
        low = sums[:-1, :-1]
        up, left, whole = sums[:-1, -1:], sums[-1:, :-1], sums[-1, -1]
        return np.stack([low, up - low, left - low, whole - up - left + low])

    g, h = corners(gradient), corners(weight)
    gain = (g * leaf(g, h)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = leaf(g[:, i, j], h[:, i, j])
    out = np.empty((n, n))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = values[0], values[1]
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values[2], values[3]
    return float(gain[i, j]), out


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair over quantile bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        fine, rough = self.binned(x, self.edges), self.binned(x, self.coarse)
        for bins, values in zip(fine, self.tables):
            total += values[bins]
        for i, j, values in self.pairs:
            total += values[rough[i], rough[j]]
        return sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of labelled measures; without rows it says 0.5, and with one class its smoothed share."""
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 0.5) / (len(y) + 1)
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(x.shape[1])]
    model = AdditiveModel(float(np.log(share / (1 - share))), quantiles(BINS), quantiles(PAIR_BINS))
    fine, rough = model.binned(x, model.edges), model.binned(x, model.coarse)
    model.tables = [np.zeros(BINS) for _ in fine]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f, bins in enumerate(fine):
            p = sigmoid(total)
            added = RATE * tree(np.bincount(bins, y - p, BINS), np.bincount(bins, p * (1 - p), BINS))
            model.tables[f] += added
            total += added[bins]
    cells = {(i, j): rough[i] * PAIR_BINS + rough[j] for i, j in combinations(range(len(rough)), 2)}

    def cut_pair(pair: tuple[int, int]) -> tuple[float, np.ndarray]:
        p = sigmoid(total)
        sums = (np.bincount(cells[pair], w, PAIR_BINS**2).reshape(PAIR_BINS, -1) for w in (y - p, p * (1 - p)))
        return cross_tree(*sums)

    chosen = sorted(cells, key=lambda pair: (-cut_pair(pair)[0], pair))[:PAIRS]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in model.pairs:
            added = RATE * cut_pair((i, j))[1]
            values += added
            total += added.ravel()[cells[i, j]]
    return model


def held_out() -> Column:
    """Whether a row's label is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of at most ``sample`` documents, one row per doc_id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    chosen = (
        known.groupBy("doc_id")
        .agg(F.min("quality").cast("long").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    schema = arrow_schema("doc_id long, label long, " + ", ".join(f"{name} double" for name in FEATURES))
    kind = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            x = feature_matrix(texts_of(part))
            yield pa.record_batch([part["doc_id"], part["label"], *map(pa.array, x.T)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "label", "text").mapInArrow(run, kind)
    # Rows that share a doc_id count once, whichever comes first in the order of their measures.
    once = rows.groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("row")).select("doc_id", "row.*")
    table_ = once.orderBy("doc_id").toArrow()
    x = np.column_stack([table_[name].to_numpy() for name in FEATURES]) if table_.num_rows else np.zeros((0, len(FEATURES)))
    return x, table_["label"].to_numpy().astype(float)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have measures of zero and get the score those bins have. Rows without doc_id are
    not held out and have no label. Repeated rows get equal scores; of a doc_id's labels the lowest counts.
    Other columns aren't read; without labels every score is 0.5; an empty table gives an empty result.
    """
    model = fit(*training_rows(docs, labels))
    schema = arrow_schema("doc_id long, held_out boolean, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            scores = model.score(feature_matrix(texts_of(part)))
            yield pa.record_batch([part["doc_id"], part["held_out"], pa.array(scores)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
