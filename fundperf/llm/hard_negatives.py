"""Hard-negative mining by segment summary filtering.

Vectors are made integers, and cut into equal segments; of each segment the mean and the deviation are kept. The sum of
products over a segment of n components is n times the product of the means, plus or minus at most n times the product
of the deviations, so a few numbers bound a score from both sides. Halving the segments tightens the bounds: pairs
of an anchor and a row that the bounds of one, two, four ... segments can't rule out are scored exactly. What rules
out is a score already found: the last of an anchor's best rows so far, and for negatives the range that the positive allows.

Anchors are a stated query set. They are searched in blocks, each against all rows: tasks keep the best rows of their
own share for each anchor, and a window over these few picks the best of all. The first search gives an anchor its
positives, the second, knowing their scores, the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, table

#: Components are floor(SCALE * x), held between -LIMIT and LIMIT so that all sums stay within 64 bits.
SCALE, LIMIT = 256, 1 << 20
POSITIVES, NEGATIVES = 5, 10
#: A negative's score as per cent of the positive's.
LOW, HIGH = 30, 90
#: Components of all anchors searched for at once, and of all rows worked on at once.
BLOCK, TILE = 1 << 20, 1 << 18
#: Anchors and rows whose scores are held as one matrix; the first matrices are smaller, to find scores that rule out.
ANCHORS, ROWS, FIRST_ROWS = 1024, 2048, 128
#: Segments have at least so many components; below, exact scores cost no more than bounds.
LEAST_SEGMENT = 4
#: Pairs that are scored one by one if fewer than this share of a matrix is left.
SPARSE = 0.02
NO_SCORE = np.iinfo(np.int64).min


def vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, numbered, with integer components; a written table."""
    scaled = F.transform(
        "embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return cut(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long"),
            F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            scaled.alias("v"),
        )
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of integers; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


@dataclass
class Summaries:
    """Rows of integers with the means and deviations of their segments, level by level."""

    rows: np.ndarray
    #: For each level, per row, root n times the means and root n times the deviations.
    levels: list[tuple[np.ndarray, np.ndarray]]
    norm: float

    @classmethod
    def of(cls, rows: np.ndarray) -> Summaries:
        width, parts, levels = rows.shape[1], 1, []
        exact = rows.astype(float)
        while parts * LEAST_SEGMENT <= width or parts == 1:
            first = np.arange(parts) * width // parts
            size = np.diff(np.append(first, width))
            total = np.add.reduceat(exact, first, axis=1)
            squares = np.add.reduceat(exact * exact, first, axis=1)
            mean = total / np.sqrt(size)
            levels.append((mean, np.sqrt(np.maximum(squares - mean * mean, 0))))
            parts *= 2
        return cls(rows, levels, float(np.sqrt((exact * exact).sum(axis=1).max(initial=0))))

    def take(self, index) -> Summaries:
        return Summaries(self.rows[index], [(m[index], d[index]) for m, d in self.levels], self.norm)


def exact_scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Products of all rows of two integer matrices; ``bound`` holds for every sum of products on the way."""
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def candidates(
    rows: Summaries, anchors: Summaries, allowed: np.ndarray, least: np.ndarray, most: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, exact score) of the allowed pairs whose bounds reach ``least`` and, if given, don't all exceed ``most``."""
    r, a = np.arange(len(rows.rows)), np.arange(len(anchors.rows))
    bound = rows.norm * anchors.norm
    slack = 1e-9 * bound + 1e-6
    keep = allowed & (least <= bound + slack)[None, :]
    for level, (mean, deviation) in enumerate(rows.levels):
        alive_r, alive_a = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))
        r, a, keep = r[alive_r], a[alive_a], keep[np.ix_(alive_r, alive_a)]
        if not keep.size or keep.mean() < SPARSE:
            break
        middle = mean[r] @ anchors.levels[level][0][a].T
        spread = deviation[r] @ anchors.levels[level][1][a].T
        keep &= middle + spread >= least[a] - slack
        if most is not None:
            keep &= middle - spread <= most[a] + slack
    at, of = np.nonzero(keep)
    if keep.size and len(at) >= SPARSE * keep.size:
        return r[at], a[of], exact_scores(rows.rows[r], anchors.rows[a], bound)[at, of]
    scores = np.zeros(len(at), np.int64)
    for low in range(0, len(at), ROWS):
        pair = slice(low, low + ROWS)
        scores[pair] = (rows.rows[r[at[pair]]] * anchors.rows[a[of[pair]]]).sum(axis=1)
    return r[at], a[of], scores


class Best:
    """The ``size`` best rows of every slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, size: int):
        self.scores = np.full((slots, size), NO_SCORE)
        self.ids, self.rows = np.zeros((slots, size), np.int64), np.zeros((slots, size), np.int64)

    def least(self) -> np.ndarray:
        """The score that a row needs to be among a slot's best."""
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        good = score >= self.least()[slot]
        if not good.any():
            return
        slot, score, ident, row = slot[good], score[good], ident[good], row[good]
        touched = np.unique(slot)
        size = self.scores.shape[1]
        old = self.scores[touched].ravel() > NO_SCORE
        slot = np.concatenate((slot, np.repeat(touched, size)[old]))
        score, ident, row = (
            np.concatenate((new, kept[touched].ravel()[old]))
            for new, kept in ((score, self.scores), (ident, self.ids), (row, self.rows))
        )
        order = np.lexsort((row, ident, -score, slot))
        slot, score, ident, row = slot[order], score[order], ident[order], row[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        top = place < size
        for kept, new in ((self.scores, score), (self.ids, ident), (self.rows, row)):
            kept[slot[top], place[top]] = new[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores > NO_SCORE)
        return slot, self.scores[slot, place], self.ids[slot, place], self.rows[slot, place]


@dataclass
class Anchors:
    """A block of anchors: their rows, ids, labels and vectors, and for each the ranges of scores it looks for."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    #: For each anchor and place the range of scores of negatives; None while positives are sought.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, vec_id, label and vector of rows in pieces; small ones first."""
    limit = FIRST_ROWS
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, limit)
            yield *(part[c].to_numpy() for c in ("row", "vec_id", "label")), matrix(part["v"], width)
            start += limit
            limit = min(limit * 2, ROWS, max(1, TILE // max(1, width)))


def searched(batches: Iterator[pa.RecordBatch], anchors: Anchors, size: int) -> Best:
    """The best rows of one task: positives of each anchor, or negatives of each anchor and place."""
    width = anchors.vectors.shape[1]
    places = 1 if anchors.low is None else anchors.low.shape[1]
    best = Best(len(anchors.row) * places, size)
    own = Summaries.of(anchors.vectors)
    if anchors.low is None:
        # A label's anchors and rows meet; each label once.
        groups = [np.flatnonzero(anchors.label == label) for label in np.unique(anchors.label)]
    else:
        groups = [np.arange(len(anchors.row))]
    parts = [g[at : at + ANCHORS] for g in groups for at in range(0, len(g), ANCHORS)]
    taken = [own.take(part) for part in parts]
    for row, vec_id, label, values in tiles(batches, width):
        every = Summaries.of(values)
        for part, mine in zip(parts, taken):
            if anchors.low is None:
                at = np.flatnonzero(label == anchors.label[part[0]])
                if not at.size:
                    continue
                allowed = row[at][:, None] != anchors.row[part][None, :]
                r, a, score = candidates(every.take(at), mine, allowed, best.least()[part], None)
                best.add(part[a], score, vec_id[at[r]], row[at[r]])
                continue
            slots = part[:, None] * places + np.arange(places)
            need, high = np.maximum(anchors.low[part], best.least()[slots]), anchors.high[part]
            some = need <= high
            least = np.where(some, need, np.iinfo(np.int64).max).min(axis=1)
            most = np.where(some, high, NO_SCORE).max(axis=1)
            allowed = (label[:, None] != anchors.label[part][None, :]) & some.any(axis=1)[None, :]
            r, a, score = candidates(every, mine, allowed, least, most)
            for place in range(places):
                hit = np.flatnonzero((score >= need[a, place]) & (score <= high[a, place]))
                best.add(slots[a[hit], place], score[hit], vec_id[r[hit]], row[r[hit]])
    return best


def nearest(rows: DataFrame, anchors: Anchors, size: int) -> DataFrame:
    """(slot, score, vec_id, row, place): the ``size`` best rows of each slot over all tasks, place from 1."""
    kind = "slot long, score long, vec_id long, row long"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, score, ident, row = searched(batches, anchors, size).found()
        yield pa.record_batch([pa.array(c) for c in (slot, score, ident, row)], schema=schema)

    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id", "row")
    ranked = rows.mapInArrow(run, kind).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= size)


def block_of(rows: list, width: int) -> Anchors:
    values = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        values[i, : len(r["v"])] = r["v"]
    row, vec_id, label = (np.array([r[c] for r in rows], np.int64) for c in ("row", "vec_id", "label"))
    return Anchors(row, vec_id, label, values)


def mined(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result rows of one block of anchors, as a written table."""
    first = nearest(rows, anchors, positives).collect()  # ``positives`` for each anchor of the block
    shape = (len(anchors.row), positives)
    score, ident, known = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    for r in first:
        at = r["slot"], r["place"] - 1
        score[at], ident[at], known[at] = r["score"], r["vec_id"], True
    # Whole numbers s with low * score <= 100 * s <= high * score; none where there is no positive.
    anchors.low = np.where(known, -((-low * score) // 100), 1)
    anchors.high = np.where(known, (high * score) // 100, 0)
    kind = "slot long, anchor_id long, positive_id long, positive_score long"
    pairs = pa.table(
        {
            "slot": pa.array(np.flatnonzero(known.ravel())),
            "anchor_id": pa.array(np.repeat(anchors.vec_id, positives)[known.ravel()]),
            "positive_id": pa.array(ident[known]),
            "positive_score": pa.array(score[known]),
        }
    )
    named = rows.sparkSession.createDataFrame(pairs, kind)
    return cut(
        nearest(rows, anchors, negatives)
        .join(named, "slot")
        .select(
            "anchor_id",
            "positive_id",
            F.col("place").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def mine_hard_negatives(
    embeddings: DataFrame,
    is_anchor: Callable = lambda vec_id: vec_id % 100 == 0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Rows without vec_id, label or vector, or with a missing or non-finite component, take no part. Components are
    held within LIMIT; shorter vectors count as filled up with zeros, so an empty one scores 0 with all. A repeated row is
    another row: it may be a positive of its copy, and copied anchors give their rows again. Ties go by vec_id. An
    anchor without positives, or a positive without rows in its range, gives none. Other columns aren't read; an
    empty table gives an empty result. Blocks of anchors, at most BLOCK components each, pass through the driver one by
    one; all rows are searched for each block.
    """
    rows = vectors(embeddings)
    chosen = rows.filter(is_anchor(F.col("vec_id")))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    count = chosen.count()
    blocks = max(1, -(-count * width // BLOCK))
    out = rows.sparkSession.createDataFrame(
        [],
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )
    for block in range(blocks if count else 0):
        own = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()
        if own:
            found = mined(rows, block_of(own, width), positives, negatives, low, high)
            out = found if block == 0 else out.unionAll(found)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH vectors AS (
    SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.id AS anchor, a.vec_id AS anchor_id, r.id, r.vec_id, a.label = r.label AS alike,
        list_inner_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.id <> r.id
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, id, score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.vec_id, s.id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.alike
WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
