"""SimHash near-duplicates: a hierarchical index over fingerprints in Gray order.

Fingerprints within ``distance`` bits agree on all but ``distance`` of B bit blocks, so the upper nodes of
the index are the masked bit patterns of B - distance blocks: every pair that links meets below at least one
of them. Below a node the fingerprints stand in Gray order. Runs of neighbours form inner nodes that factor
out the bits all their members share; two nodes whose shared bits already differ in more than ``distance``
places are pruned as a whole, and so are nodes known to lie in one component. Only a spanning forest leaves
a node, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, cut, table, text_slices, texts_of, version_of
from .graph import connected_components

SHINGLE = 4
DISTANCE = 4
BLOCKS = 6
SEED = 42
#: Fan-out of inner nodes, and the group size up to which neighbours are compared directly.
FAN, LEAF = 16, 32
#: Node pairs taken from the stack at once.
PAIRS = 1 << 12

UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text (zero without words)."""
    words = text.translate(UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > len(hashes)).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, fp long) of every document; null texts count as empty."""
    kind = "doc_id long, version binary, fp long"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            values = [fingerprint(text, shingle) for text in texts_of(part)]
            yield pa.record_batch(
                [part["doc_id"].cast(pa.int64()), part["version"], pa.array(values, pa.int64())], schema=schema
            )

    return docs.select("doc_id", version_of().alias("version"), "text").mapInArrow(run, kind)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``blocks - distance`` of the bit blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(choice) for choice in combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(column: Column) -> Column:
    """Place of a code in the reflected Gray order (as a signed integer)."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if np.array_equal(before, label):
            break
    return label


class GrayTree:
    """Nodes over fingerprints in Gray order: at each level the bits that all members share."""

    def __init__(self, codes: np.ndarray):
        self.ones, self.zeros = [codes], [~codes]
        while len(self.ones[-1]) > 1:
            at = np.arange(0, len(self.ones[-1]), FAN)
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], at))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], at))

    def differences(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound for the differing bits of any two members of two nodes; exact for leaves."""
        ones, zeros = self.ones[level], self.zeros[level]
        return np.bitwise_count((ones[i] & zeros[j]) | (zeros[i] & ones[j]))

    def owners(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the component that holds a whole node, or -1."""
        out = [label]
        for ones in self.ones[1:]:
            at = np.arange(0, len(out[-1]), FAN)
            low = np.minimum.reduceat(out[-1], at)
            high = np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def link_group(codes: np.ndarray, distance: int) -> np.ndarray:
    """Component labels of one group of fingerprints in Gray order, links at ``distance`` bits or fewer."""
    n = len(codes)
    a_parts, b_parts = [], []
    for turn in range(0, 64, 16):  # neighbours in a few rotated orders join most of a dense group
        turned = (codes >> np.uint64(turn)) | (codes << np.uint64(64 - turn)) if turn else codes
        order = np.argsort(turned, kind="stable") if turn else np.arange(n)
        for step in range(1, min(5, n)):
            i, j = order[:-step], order[step:]
            near = np.bitwise_count(codes[i] ^ codes[j]) <= distance
            a_parts.append(i[near])
            b_parts.append(j[near])
    label = forest(n, np.concatenate(a_parts), np.concatenate(b_parts))
    tree = GrayTree(codes)
    owners = tree.owners(label)
    top = len(tree.ones) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    fan = np.arange(FAN)
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS:
            stack.append((level, i[PAIRS:], j[PAIRS:]))
            i, j = i[:PAIRS], j[:PAIRS]
        own = owners[level]
        keep = (own[i] != own[j]) | (own[i] < 0)
        i, j = i[keep], j[keep]
        keep = tree.differences(level, i, j) <= distance
        i, j = i[keep], j[keep]
        if not i.size:
            continue
        if level == 0:
            root = forest(n, label[i], label[j])
            label = root[label]
            owners = tree.owners(label)
            continue
        size = len(tree.ones[level - 1])
        left = np.repeat((i[:, None] * FAN + fan)[:, :, None], FAN, axis=2).ravel()
        right = np.repeat((j[:, None] * FAN + fan)[:, None, :], FAN, axis=1).ravel()
        inside = (left <= right) & (left < size) & (right < size)
        if level == 1:
            inside &= left < right
        stack.append((level - 1, left[inside], right[inside]))
    return label


def group_links(group: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges (member, smallest index of its component) of consecutive groups of codes."""
    n = len(codes)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    a_parts, b_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # members from here on
    small = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
    for step in range(1, LEAF):
        small = small[left[small] > step]
        if not small.size:
            break
        near = np.bitwise_count(codes[small] ^ codes[small + step]) <= distance
        a_parts.append(small[near])
        b_parts.append(small[near] + step)
    for start, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        label = link_group(codes[start : start + size], distance)
        moved = np.flatnonzero(label != np.arange(size))
        a_parts.append(start + moved)
        b_parts.append(start + label[moved])
    label = forest(n, np.concatenate(a_parts), np.concatenate(b_parts))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def fingerprint_links(codes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` exactly as all links would.

    With more than 2**24 fingerprints, more blocks keep the groups short; the result is the same.
    """
    masks = block_masks(blocks, distance)
    nodes = F.array(
        *[F.struct(F.lit(i).alias("node"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
    )
    placed = (
        codes.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(nodes).alias("at"))
        .select(F.xxhash64("at.node", "at.bits").alias("spread"), "at.node", "at.bits", "rank", "fp")
        .repartition("spread")
        .sortWithinPartitions("node", "bits", "rank")
        .select("node", "bits", "fp")
    )
    schema = arrow_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(node, bits, codes):
            change = (node[1:] != node[:-1]) | (bits[1:] != bits[:-1])
            group = np.concatenate(([0], np.cumsum(change)))
            a, b = group_links(group, codes.view(np.uint64), distance)
            return pa.record_batch([pa.array(codes[a]), pa.array(codes[b])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            node, bits, codes = (batch[c].to_numpy() for c in ("node", "bits", "fp"))
            same = (node == node[-1]) & (bits == bits[-1])
            if held and not (held[0][0][0] == node[-1] and held[0][1][0] == bits[-1]):
                begin = int(np.argmax(same))
                held.append((node[:begin], bits[:begin], codes[:begin]))
                yield flush(*map(np.concatenate, zip(*held)))
                held = [(node[begin:], bits[begin:], codes[begin:])]
            elif held:
                held.append((node, bits, codes))
            else:
                begin = int(np.argmax(same))
                if begin:
                    yield flush(node[:begin], bits[:begin], codes[:begin])
                held = [(node[begin:], bits[begin:], codes[begin:])]
        if held:
            yield flush(*map(np.concatenate, zip(*held)))

    return placed.mapInArrow(run, "u long, v long")


def near_duplicate_groups(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS
) -> DataFrame:
    """(doc_id, version, fp, root, component_id) of every document; root names the component.

    Equal fingerprints count once in the search, so exact copies add no work. component_id is the smallest
    doc_id reachable over links. Null and wordless texts have fingerprint zero and link like any other;
    repeated rows stay rows; a null doc_id is never the smallest unless a component has no other. Other
    columns aren't read; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle))
    codes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = connected_components(fingerprint_links(codes.select("fp"), distance, blocks))
    rooted = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    smallest = cut(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    named = cut(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select("doc_id", "version", "fp", "root", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
