"""Near-duplicates by SimHash: segment popcounts as a grid, exact check, components.

A fingerprint is cut into 16 segments of 4 bits and mapped to the vector of their bit counts.  One differing bit moves one count
by one, so the Manhattan distance of two vectors is at most the number of differing bits: fingerprints within two bits have
vectors within two steps, and meet in the cell of one of the two or in one between them.  Every distinct fingerprint is sent
to its own cell and the 32 around it, candidates that share a cell are checked bit by bit, and only a spanning forest of the links
leaves a task.  A crowded cell is linked through the 65 fingerprints within one bit of each member, which is exact as well and
linear in its members, so no task forms all pairs of a group.

Null or empty text, and text of spaces only, has fingerprint 0 and is linked like any other.  Copies meet as one fingerprint.
Repeated rows are rows of the result each.  A null id belongs to its component but is not its smallest id; a component of null
ids only has a null id.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import LOWER, WORD_BYTE, chunks, text_bytes, words
from callweave.llm.components import components
from callweave.session import cut

SEGMENTS, SEGMENT_BITS, STEP_BITS = 16, 4, 3
CROWDED = 256


def shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int):
    """The texts with single spaces, and per shingle its begin and end there; then the running number of shingles per text."""
    starts, ends, before = words(data, offsets)
    inside = WORD_BYTE[data]
    keep = inside.copy()
    after = ends[ends < len(data)]
    keep[after[~inside[after]]] = True  # one separator after each word
    moved = np.cumsum(keep)
    flat = np.where(inside, data, 0x20)[keep].astype(np.uint8).tobytes()
    starts, ends = moved[starts] - 1, moved[ends - 1] if len(ends) else ends
    counts = np.diff(before)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = np.concatenate([[0], np.cumsum(made)])
    within = np.arange(total[-1]) - np.repeat(total[:-1], made)
    first = np.repeat(before[:-1], made) + within
    last = first + np.repeat(np.minimum(counts, width), made) - 1
    return flat, starts[first], ends[last], total


def fingerprints_of(column: pa.Array, width: int = 3) -> np.ndarray:
    """One 64-bit SimHash per text over its lower-cased ``width``-word shingles, each counted as often as it occurs."""
    data, offsets = text_bytes(column)
    flat, begins, ends, total = shingle_spans(LOWER[data], offsets, width)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], 42) for a, b in zip(begins.tolist(), ends.tolist())], dtype=">u8")
    made = np.diff(total)
    prints = np.zeros(len(made), dtype=np.uint64)
    filled = np.flatnonzero(made)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, total[:-1][filled], axis=0, dtype=np.int64)
        prints[filled] = np.packbits(2 * ones > made[filled][:, None], axis=1).view(">u8").ravel()
    return prints


def fingerprinted(docs: DataFrame, width: int = 3, key: Column | None = None) -> DataFrame:
    """(key, doc_id, fp): the fingerprint as a signed 64-bit number; ``key`` (a long) finds the row again."""

    def mark(batches):
        for batch in chunks(batches):
            prints = fingerprints_of(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(prints.astype(np.uint64).view(np.int64))],
                                             names=["key", "doc_id", "fp"])

    doc_id = F.col("doc_id").cast("long")
    picked = docs.select((doc_id if key is None else key).alias("key"), doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(mark, "key long, doc_id long, fp long")


class _Forest:
    """Components of numbered nodes under batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while True:
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            a, b = self.root[a], self.root[b]


def _few_bits(x: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(x) <= most


def links_in_cells(cells: np.ndarray, prints: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints that share a cell and differ in ``most`` (2) bits or fewer."""
    nodes, member = np.unique(prints, return_inverse=True)
    order = np.argsort(cells, kind="stable")
    cells, member = cells[order], member[order]
    edge = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    size = np.diff(edge)
    forest = _Forest(len(nodes))
    group = np.repeat(size, size)
    small = np.flatnonzero((group > 1) & (group <= CROWDED))
    for apart in range(1, CROWDED):
        small = small[small + apart < len(cells)]
        small = small[cells[small] == cells[small + apart]]
        if not len(small):
            break
        a, b = member[small], member[small + apart]
        close = _few_bits(nodes[a] ^ nodes[b], most)
        forest.link(a[close], b[close])
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for k in np.flatnonzero(size > CROWDED):
        own = np.unique(member[edge[k]: edge[k + 1]])
        slices = 1 + len(own) * 65 // (1 << 22)
        for s in range(slices):  # only as many midpoints at once as fit in memory
            mids, whose = [], []
            for part in np.array_split(own, 1 + len(own) // (1 << 14)):
                mid = nodes[part][:, None] ^ flips[None, :]
                here = (mid * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices) == s
                mids.append(mid[here])
                whose.append(np.broadcast_to(part[:, None], mid.shape)[here])
            mids, whose = np.concatenate(mids), np.concatenate(whose)
            rank = np.argsort(mids, kind="stable")
            same = np.flatnonzero(mids[rank[1:]] == mids[rank[:-1]])
            forest.link(whose[rank[same]], whose[rank[same + 1]])
    child = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[child], nodes[forest.root[child]]


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within two bits, without listing every pair."""
    nibble = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * s).bitwiseAND(F.lit(15).cast("long"))).cast("long") + 1 for s in range(SEGMENTS)]
    cell = nibble[0]
    for s in range(1, SEGMENTS):
        cell = cell + F.shiftleft(nibble[s], STEP_BITS * s)
    steps = [0] + [sign << (STEP_BITS * s) if sign > 0 else -(1 << (STEP_BITS * s)) for s in range(SEGMENTS) for sign in (1, -1)]
    placed = prints.select("fp", cell.alias("own")).select("fp", F.explode(F.array(*[F.col("own") + F.lit(x).cast("long") for x in steps])).alias("cell"))

    def meet(batches):
        held = [(b.column("cell").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if held:
            cells, fps = (np.concatenate(x) for x in zip(*held))
            a, b = links_in_cells(cells, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "cell").mapInArrow(meet, "a long, b long")


def grouped(docs: DataFrame, width: int = 3, key: Column | None = None) -> DataFrame:
    """(key, doc_id, fp, component, component_id): component names the group, component_id is the smallest doc_id in it.

    Fingerprints are linked when they differ in two bits or fewer; groups are what is reachable over links.
    """
    marked = cut(fingerprinted(docs, width, key), "prints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(near_links(distinct.select("fp")))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("component"), "component_id")
    return marked.join(placed, F.col("fp") == F.col("_fp")).select("key", "doc_id", "fp", "component", "component_id")
