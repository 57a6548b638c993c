"""Benchmark decontamination by latent semantic retrieval.

Documents are written once as word numbers (32 hash bits a word). Their passages of SPAN words, as TF-IDF rows
over DIM hashed words, form a matrix A; a randomised SVD gives its strongest right singular vectors: each task
multiplies its rows with a sparse random matrix and back (A'A Omega), the small products are summed, and the
driver factors them (Nystroem). Frequencies and space are fitted on all passages. A passage's latent vector is its projection, whitened by the singular values.
As that is linear, sums over blocks of words give the vector of a window at every STRIDE-th word, of SPAN
words or of SHORT_SPAN for short items. Windows whose cosine with a window of a benchmark item is high enough
are candidates, found by way of one coarse vector for neighbouring windows of an item; there the longest common subsequence of the item's words and the passage must cover SHARE of
the item, and ANSWER of the answer if the item marks one. Edited copies and paraphrases keep the order of most words and
pass; passages of the same vocabulary don't.

The cosine of a short or much edited copy may be low, so candidates also come from seeds: a passage that holds
``need`` of an item's n words holds SEEDS of any n - need + SEEDS of them. The rarest so many are sought in all
documents, and wherever SEEDS of them stand close enough for one passage is a candidate. None that the checks
would accept is missed, whatever the item's length (with fewer inserted words than ``room`` has).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, cut, kept_in_worker, splitmix, table, text_slices, texts_of, version_of
from .license_scan import FOLD
from .substring_dedup import Rolling

DIM, RANK, OVERSAMPLE = 4096, 96, 16
#: Entries in a row of the random matrix.
ENTRIES = 4
SPAN, STRIDE, SHORT_SPAN = 24, 8, 12
#: Least cosine of candidates, by span.
COSINE = {SPAN: 0.55, SHORT_SPAN: 0.65}
#: Windows of an item that begin within so many words have one coarse vector, that of all their words. It is compared first;
#: a window that falls short of COARSE of what a whole copy would reach there is not compared with the single ones.
GROUP, COARSE = 12, 0.8
#: Windows and coarse vectors multiplied at once, and pairs compared one by one.
TILE_ROWS, TILE_QUERIES, PAIRS = 4096, 2048, 1 << 15
SHARE, ANSWER = 0.6, 0.5
#: Items with fewer words than this must be found whole.
WHOLE = 8
#: Rare words of an item that must stand together (fewer if the item needs fewer), and bits of their lookup table.
SEEDS, MARK_BITS = 4, 20
#: Benchmark items searched for at once; larger benchmarks take several passes.
BLOCK = 5000
SEED = 20240607
#: What each byte stands for in a word's hash, and bytes hashed at once.
BYTES = splitmix(np.arange(1, 257))
BLOCK_BYTES = 1 << 20
#: Rows of the matrix summed as one piece, and words worked on at once; fitting takes more, for fewer sums per feature.
PIECE, WORDS, FIT_WORDS = 256, 100_000, 400_000


def folded(text: bytes) -> bytes:
    """A text in lower case, of all alphabets, with a blank for each byte that is in no word."""
    return (text if text.isascii() else text.decode().lower().encode()).translate(FOLD)


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, of all alphabets, without punctuation."""
    return folded(text).split()


def numbers(texts: list[bytes]) -> list[np.ndarray]:
    """The word numbers of each text, 32 hash bits a word.

    A word's hash is the polynomial of its bytes modulo 2**64, mixed: the difference of two prefix sums over all
    bytes, moved to the origin. Blocks end between words, so a long text takes no more memory than a short one.
    """
    parts = [folded(text) for text in texts]
    whole = b" ".join(parts)
    starts, codes, low = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], 0
    while low < len(whole):
        high = len(whole)
        if low + BLOCK_BYTES < high:
            high = whole.rfind(b" ", low, low + BLOCK_BYTES)
            if high < 0:
                found = whole.find(b" ", low + BLOCK_BYTES)
                high = len(whole) if found < 0 else found
        data = np.frombuffer(whole, np.uint8, high - low, low)
        inside = np.concatenate(([False], data != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        rolling = Rolling(BYTES[data])
        codes.append(rolling.run(edges[0::2], edges[1::2]).astype(np.uint32))
        starts.append(edges[0::2] + low)
        low = high + 1
    first = np.cumsum([0, *(len(part) + 1 for part in parts)])
    return np.split(np.concatenate(codes), np.searchsorted(np.concatenate(starts), first[1:-1]))


def coded(docs: DataFrame) -> DataFrame:
    """(doc_id, version, codes): the word numbers of every document, as little-endian 32-bit integers."""
    kind = "doc_id long, version binary, codes binary"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            codes = [own.tobytes() for own in numbers(texts_of(part))]
            yield pa.record_batch([part["doc_id"], part["version"], pa.array(codes, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), version_of().alias("version"), "text")
    return rows.mapInArrow(run, kind)


def codes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(value, np.uint32) for value in batch["codes"].to_pylist()]


def passages(documents: list[np.ndarray], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of consecutive documents and the passage of each word, about ``words`` words at a time."""
    features, places, size, passage = [], [], 0, 0
    for codes in documents:
        for low in range(0, len(codes), WORDS // SPAN * SPAN):
            own = (codes[low : low + WORDS // SPAN * SPAN] % DIM).astype(np.uint16)
            features.append(own)
            places.append(passage + np.arange(len(own)) // SPAN)
            passage = int(places[-1][-1]) + 1
            size += len(own)
            if size >= words:
                yield np.concatenate(features), np.concatenate(places)
                features, places, size, passage = [], [], 0, 0
    if features:
        yield np.concatenate(features), np.concatenate(places)


def summed(docs: DataFrame, rows: int, width: int, local) -> np.ndarray:
    """The sum of ``local(batches)``, a (rows, width) array of each task, by pieces of PIECE rows."""
    schema = arrow_schema("piece int, part binary")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = local(batches)
        if total is not None:
            parts = [total[at : at + PIECE].astype(np.float32).tobytes() for at in range(0, rows, PIECE)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, part in zip(batch["piece"].to_pylist(), batch["part"].to_pylist()):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(part, np.float32).astype(float)
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], schema=schema
        )

    parts = docs.select("codes").mapInArrow(emit, "piece int, part binary")
    found = parts.repartition("piece").mapInArrow(add, "piece int, part binary").collect()
    out = np.zeros((rows, width))
    for row in found:
        at = row["piece"] * PIECE
        out[at : at + PIECE] = np.frombuffer(row["part"]).reshape(-1, width)
    return out


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every feature over all passages, above zero for words of every passage, too."""

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for part in text_slices(batches, "codes"):
            for own, passage in passages(codes_of(part)):
                total = np.zeros((DIM + 1, 1)) if total is None else total
                order = np.argsort(own, kind="stable")
                feature, at = own[order], passage[order]
                new = np.concatenate(([True], (feature[1:] != feature[:-1]) | (at[1:] != at[:-1])))
                total[:DIM, 0] += np.bincount(feature[new], minlength=DIM)
                total[DIM] += passage[-1] + 1
        return total

    counts = summed(docs, DIM + 1, 1, local)[:, 0]
    return np.log((counts[DIM] + 2) / (counts[:DIM] + 1))


def random_matrix() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of each row's ENTRIES entries."""
    random, width = np.random.default_rng(SEED), RANK + OVERSAMPLE
    columns = np.argsort(random.random((DIM, width)), axis=1)[:, :ENTRIES]
    return columns, random.choice([-1.0, 1.0], (DIM, ENTRIES))


def latent_vectors(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """One vector for each feature, fitted on all passages: a passage's latent vector is the sum over its words."""
    width = RANK + OVERSAMPLE

    def local(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        columns, signs = random_matrix()
        weighted = signs * idf[:, None]
        for part in text_slices(batches, "codes"):
            for own, passage in passages(codes_of(part), FIT_WORDS):
                total = np.zeros((DIM, width)) if total is None else total
                cells = passage[:, None] * width + columns[own]
                rows = np.bincount(cells.ravel(), weighted[own].ravel(), (passage[-1] + 1) * width)
                rows = rows.reshape(-1, width).astype(np.float32)
                order = np.argsort(own, kind="stable")
                feature, at = own[order].astype(np.int64), passage[order]
                first = np.flatnonzero(np.diff(feature, prepend=-1))
                # One feature at a time: its rows stay in the cache, where a sum over all at once copies them.
                for k, low, high in zip(feature[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)]):
                    total[k] += rows[at[low:high]].sum(axis=0)
        return None if total is None else total * idf[:, None]

    product = summed(docs, DIM, width, local)
    omega = np.zeros((DIM, width))
    np.put_along_axis(omega, *random_matrix(), axis=1)
    core = omega.T @ product
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > 1e-9 * max(values[-1], 1e-300)
    factor = product @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, strength, _ = np.linalg.svd(factor, full_matrices=False)
    rank = min(RANK, int((strength > 1e-6 * strength[:1].sum()).sum()))
    return (idf[:, None] * left[:, :rank] / strength[:rank]).astype(np.float32)


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a sequence of n words, given as bit masks, and ``words``."""
    full = (1 << n) - 1
    row = full
    for word in words:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def word_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


@dataclass
class Item:
    """A benchmark item, ready to be looked for: word numbers, and those of its answer if it marks one."""

    item_id: int
    words: list[int]
    answer: list[int]

    @classmethod
    def of(cls, item_id: int, text: bytes) -> Item:
        """The answer is what follows the last word ``answer``; without one the whole item stands for it."""
        words, known = words_of(text), numbers([text])[0].tolist()
        marked = [i for i, w in enumerate(words[:-1]) if w in (b"answer", b"answers")]
        return cls(item_id, known, known[marked[-1] + 1 :] if marked else known)

    def __post_init__(self):
        n = len(self.words)
        self.distinct = np.unique(np.array(self.words, np.uint32), return_counts=True)
        self.masks, self.answer_masks = word_masks(self.words), word_masks(self.answer)
        self.need = max(math.ceil(SHARE * n), min(n, WHOLE))
        self.answer_need = math.ceil(ANSWER * len(self.answer))

    def windows(self) -> tuple[int, list[int]]:
        """Span and starts of the windows that are looked for."""
        n = len(self.words)
        span, step = (SPAN, SPAN // 2) if n >= SPAN else (SHORT_SPAN, 2)
        return span, [0] if n <= span else sorted({*range(0, n - span, step), n - span})

    def room(self) -> tuple[int, int]:
        """Words of a passage before the item's first word, and from it on: room for insertions."""
        n = len(self.words)
        return STRIDE + n // 8, n + 2 * STRIDE + n // 4

    def seeds(self, idf: np.ndarray) -> tuple[int, list[int]]:
        """How many seeds a passage needs, and the places of the rarest words, of which it must hold so many."""
        least = min(SEEDS, self.need)
        rare = np.argsort(-idf[np.array(self.words) % DIM], kind="stable")
        return least, rare[: len(self.words) - self.need + least].tolist()

    def found(self, words: list[int]) -> tuple[float, float] | None:
        """Shares of the item and of its answer (of the item again if it marks none) in a passage, if both suffice."""
        if sum(map(set(words).__contains__, self.words)) < self.need:
            return None  # an upper bound of what follows
        whole = common_length(self.masks, len(self.words), words)
        if whole < self.need:
            return None
        if self.answer == self.words:
            return whole / len(self.words), whole / len(self.words)
        answer = common_length(self.answer_masks, len(self.answer), words)
        return (whole / len(self.words), answer / len(self.answer)) if answer >= self.answer_need else None


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Searcher:
    """Looks for benchmark items in documents."""

    def __init__(self, items: list[tuple[int, bytes]], vectors: np.ndarray, idf: np.ndarray):
        self.items = [item for i, text in items if (item := Item.of(i, text)).words]
        #: One more row, of zeros, for the room between documents.
        self.vectors = np.concatenate((vectors, np.zeros((1, vectors.shape[1]), np.float32)))
        #: For each span the unit vectors, item places and first words of its windows.
        self.queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: For each span the coarse unit vectors, their least cosines, and the first and the number of their windows.
        self.coarse: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        fine: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        groups: dict[int, list[tuple[np.ndarray, float, int, int]]] = {}
        for k, item in enumerate(self.items):
            own = np.array(item.words) % DIM
            span, starts = item.windows()
            rows = fine.setdefault(span, [])
            while starts:
                near = [a for a in starts if a - starts[0] <= GROUP]
                starts = starts[len(near) :]
                whole = vectors[own[near[0] : near[-1] + span]].sum(axis=0)
                # A window within the group's words reaches about this share of its own cosine.
                share = math.sqrt(min(span, len(own)) / min(len(own), near[-1] + span - near[0]))
                groups.setdefault(span, []).append((whole, COARSE * share * COSINE[span], len(rows), len(near)))
                rows.extend((vectors[own[a : a + span]].sum(axis=0), k, a) for a in near)
        for span, rows in fine.items():
            found, owner, offset = zip(*rows)
            self.queries[span] = (unit(np.array(found, np.float32)).T, np.array(owner), np.array(offset))
            whole, least, first, count = zip(*groups[span])
            self.coarse[span] = (unit(np.array(whole, np.float32)).T, np.array(least, np.float32), np.array(first), np.array(count))
        #: For each item the seeds it needs, and the length of its passages.
        self.least = np.zeros(len(self.items), np.int64)
        self.reach = np.array([sum(item.room()) for item in self.items], np.int64)
        seeds: list[tuple[int, int, int]] = []
        for k, item in enumerate(self.items):
            self.least[k], places = item.seeds(idf)
            seeds.extend((item.words[j], k, j) for j in places)
        seeds.sort()
        words, self.seed_item, self.seed_place = np.array(seeds, np.int64).reshape(-1, 3).T
        self.seed_words, self.seed_first, self.seed_count = np.unique(words, return_index=True, return_counts=True)
        self.marks = np.zeros(1 << MARK_BITS, bool)
        self.marks[self.seed_words & ((1 << MARK_BITS) - 1)] = True

    def blocks(self, features: np.ndarray) -> np.ndarray:
        """Sums over every half STRIDE of words."""
        half = STRIDE // 2
        out = self.vectors[features[0::half]]
        for i in range(1, half):
            out += self.vectors[features[i::half]]
        return out

    def windows(self, blocks: np.ndarray, span: int) -> np.ndarray:
        """Sums over the windows of ``span`` words at every STRIDE-th word, zeros beyond the end."""
        whole = blocks[0::2] + blocks[1::2]
        if span == SHORT_SPAN:
            whole[:-1] += blocks[2::2]
            return whole
        out = whole.copy()
        out[:-1] += whole[1:]
        out[:-2] += whole[2:]
        return out

    def candidates(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(document, item place, word where the item would begin, cosine) of near windows and of seeds, whose cosine is NaN.

        Places whose passage lacks too many of the item's words are left out.
        """
        parts: list[tuple[int, int, np.ndarray]] = []
        size, beyond = 0, max(SPAN, int(self.reach.max()))
        sizes = np.array([len(codes) for codes in documents])
        whole = np.concatenate(documents), np.cumsum(sizes) - sizes, np.cumsum(sizes)
        for d, codes in enumerate(documents):
            for low in range(0, len(codes), WORDS):
                parts.append((d, low, codes[low : low + WORDS + beyond]))
                size += len(parts[-1][2])
                if size >= WORDS:
                    yield from self.possible(parts, whole)
                    parts, size = [], 0
        if parts:
            yield from self.possible(parts, whole)

    def possible(self, parts, whole) -> Iterator[tuple[int, int, int, float]]:
        both = [self.near(parts), self.seeded(parts)]
        place = np.concatenate([found for found, _ in both], axis=1)
        cosine = np.concatenate([found for _, found in both])
        # Near windows come first, so a place that both found keeps its cosine.
        place, once = np.unique(place, axis=1, return_index=True)
        keep = self.held(whole, *place)
        for (d, k, begin), value in zip(place[:, keep].T.tolist(), cosine[once[keep]].tolist()):
            yield d, k, begin, value

    def held(self, whole, document: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which places have as many of the item's words, in any order, as the item needs."""
        codes, first, stop = whole
        keep = np.zeros(len(item), bool)
        order = np.argsort(item, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
            one = self.items[item[own[0]]]
            before, after = one.room()
            words, times = one.distinct
            for at in range(0, len(own), TILE_ROWS):
                rows = own[at : at + TILE_ROWS]
                low = first[document[rows]] + np.maximum(0, begin[rows] - before)
                places = low[:, None] + np.arange(before + after)
                inside = places < stop[document[rows]][:, None]
                passage = codes[np.where(inside, places, 0)]
                word = np.minimum(np.searchsorted(words, passage), len(words) - 1)
                row, column = np.nonzero(inside & (words[word] == passage))
                present = np.zeros((len(rows), len(words)), np.int64)
                present[row, word[row, column]] = 1
                keep[rows] = present @ times >= one.need
        return keep

    def seeded(self, parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Places where as many seeds of an item as it needs stand within the length of its passages, and NaN for each."""
        sizes = np.array([len(own) for *_, own in parts])
        first = np.cumsum(sizes) - sizes
        codes = np.concatenate([own for *_, own in parts])
        at = np.flatnonzero(self.marks[codes & np.uint32((1 << MARK_BITS) - 1)])
        words = codes[at].astype(np.int64)
        seed = np.minimum(np.searchsorted(self.seed_words, words), len(self.seed_words) - 1)
        same = self.seed_words[seed] == words
        at, seed = at[same], seed[same]
        if not at.size:
            return np.zeros((3, 0), np.int64), np.zeros(0, np.float32)
        count = self.seed_count[seed]
        at = np.repeat(at, count)
        row = np.arange(len(at)) + np.repeat(self.seed_first[seed] - (np.cumsum(count) - count), count)
        order = np.argsort(self.seed_item[row], kind="stable")
        at, item, place = at[order], self.seed_item[row[order]], self.seed_place[row[order]]
        part = np.searchsorted(first, at, side="right") - 1
        last = np.arange(len(at)) + self.least[item] - 1
        full = last < len(at)
        last = np.where(full, last, 0)
        full &= (item[last] == item) & (part[last] == part) & (at[last] - at < self.reach[item])
        # What begins beyond the part's own words is found in the part that follows.
        full &= at - first[part] < WORDS
        runs = np.bincount(np.flatnonzero(full), minlength=len(at) + 1) - np.bincount(last[full] + 1, minlength=len(at) + 1)
        full = np.cumsum(runs[:-1]) > 0
        at, item, place, part = at[full], item[full], place[full], part[full]
        document, low = (np.array([p[i] for p in parts]) for i in range(2))
        begin = (at - first[part] + low[part] - place) // STRIDE * STRIDE
        found = np.unique(np.stack([document[part], item, begin]), axis=1)
        return found, np.full(found.shape[1], np.nan, np.float32)

    def cosine(self, codes: np.ndarray, place: int, begin: int) -> float:
        """The best cosine of an item's windows with the document's words at their places, to the stride."""
        item = self.items[place]
        span, starts = item.windows()
        queries, owner, _ = self.queries[span]
        own, length, best = queries[:, owner == place], min(span, len(item.words)), 0.0
        for q, start in enumerate(starts):
            for low in range(max(0, begin + start), max(0, begin + start + STRIDE)):
                window = self.vectors[codes[low : low + length] % DIM].sum(axis=0, keepdims=True)
                best = max(best, float((unit(window) @ own[:, q])[0]))
        return best

    def near(self, parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Places near whose words a window has a high cosine, and the cosine."""
        sizes = np.array([len(own) for *_, own in parts])
        room = -(-sizes // STRIDE) * STRIDE + SPAN - STRIDE
        first = np.cumsum(room) - room
        features = np.full(int(room.sum()), DIM, np.int64)
        for at, (_, _, own) in zip(first.tolist(), parts):
            features[at : at + len(own)] = own % DIM
        document, low = (np.array([p[i] for p in parts]) for i in range(2))
        part = np.repeat(np.arange(len(parts)), room // STRIDE)
        start = (np.arange(len(part)) * STRIDE - first[part]) + low[part]
        blocks = self.blocks(features)
        places, cosines = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.float32)]
        for span, (_, owner, offset) in self.queries.items():
            row, query, cosine = self.pairs(unit(self.windows(blocks, span)), span)
            # The item's first word, to the stride.
            begin = (start[row] - offset[query]) // STRIDE * STRIDE
            places.append(np.stack([document[part[row]], owner[query], begin]))
            cosines.append(cosine)
        return np.concatenate(places, axis=1), np.concatenate(cosines)

    def pairs(self, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, query, cosine) of all pairs near enough, in tiles: coarse vectors first, then those behind them."""
        queries, coarse = self.queries[span][0].T, self.coarse[span]
        found = []
        for low in range(0, len(windows), TILE_ROWS):
            for left in range(0, len(coarse[1]), TILE_QUERIES):
                whole, least, first, count = (c[..., left : left + TILE_QUERIES] for c in coarse)
                hit = np.flatnonzero(windows[low : low + TILE_ROWS] @ whole >= least)
                row, group = np.divmod(hit, len(least))
                times = count[group]
                row = low + np.repeat(row, times)
                query = np.arange(len(row)) + np.repeat(first[group] - (np.cumsum(times) - times), times)
                for at in range(0, len(row), PAIRS):
                    r, q = row[at : at + PAIRS], query[at : at + PAIRS]
                    cosine = np.einsum("ij,ij->i", windows[r], queries[q])
                    near = cosine >= COSINE[span]
                    found.append((r[near], q[near], cosine[near]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(column) for column in zip(*found))

    def search(self, documents: list[np.ndarray]) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each document item_id: (share, answer share, cosine, first word) of every item it holds."""
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in documents]
        for d, place, begin, cosine in self.candidates(documents) if self.items else ():
            item = self.items[place]
            before, after = item.room()
            low, high = max(0, begin - before), begin + after
            shares = item.found(documents[d][low:high].tolist())
            if shares and math.isnan(cosine):
                cosine = self.cosine(documents[d], place, begin)
            if shares and (*shares, cosine) > out[d].get(item.item_id, (0.0,))[:3]:
                out[d][item.item_id] = (*shares, cosine, low)
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, version, item_id, share, answer_share, cosine, first_word): benchmark items in documents.

    One row for each text of a document and each item, the best passage. Null and empty texts and items hold nothing;
    repeated rows, ties and repeated items give one row each for their ids; a null doc_id or item_id is an
    id like any other. Other columns aren't read; empty tables give an empty result. The benchmark is the
    query set: it is searched in blocks of about BLOCK items, each against all documents.
    """
    known = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    rows_ = cut(coded(docs))
    idf = inverse_frequencies(rows_)
    vectors = latent_vectors(rows_, idf)
    blocks = max(1, -(-known.count() // BLOCK))
    kind = "doc_id long, version binary, item_id long, share double, answer_share double, cosine double, first_word long"
    schema = arrow_schema(kind)

    def searching(items: list[tuple[int, bytes]], block_id: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = kept_in_worker(("decontamination", block_id), lambda: Searcher(items, vectors, idf))
            for part in text_slices(batches, "codes"):
                held = searcher.search(codes_of(part))
                rows = [
                    (doc_id, version, item_id, *found)
                    for doc_id, version, own in zip(part["doc_id"].to_pylist(), part["version"].to_pylist(), held)
                    for item_id, found in own.items()
                ]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return run

    found = None
    for block in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = [(r["item_id"], r["text"].encode()) for r in own]
        hits = rows_.mapInArrow(searching(items, uuid.uuid4().hex), kind)
        found = hits if found is None else found.unionAll(hits)
    best = F.max(F.struct("share", "answer_share", "cosine", (-F.col("first_word")).alias("back"))).alias("best")
    return cut(found.groupBy("doc_id", "version", "item_id").agg(best)).select(
        "doc_id",
        "version",
        "item_id",
        "best.share",
        "best.answer_share",
        "best.cosine",
        (-F.col("best.back")).alias("first_word"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")
