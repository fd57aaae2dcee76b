"""Near copies by word shingles: MinHash bands propose pairs, the shingle sets decide, components group.

A text is the set of its lower-cased ``width``-word shingles (all words, if there are fewer).  Texts with equal sets meet as one
digest.  128 minima in 32 bands of 4 give each set 32 cells; two sets of Jaccard similarity 0.8 share none of them with a probability
of 5e-8.  Every proposed pair is then compared set against set, so nothing below the threshold is linked.

All pairs of a cell with up to ``CROWDED`` sets are proposed.  In a larger one every set is first compared with two leaders, the set
with the most company over all its cells and the one with the smallest digest, so that a large group stays linear in its members.
The sets of such a cell that this leaves outside its largest group must then meet the sets of other groups: all of them in a cell of
up to ``SMALL`` sets, so many at most for each.  In a larger one the shingles of each set are
ordered from rare to frequent: two sets of similarity 0.8 share one among the first fifth of both, and the first one they share leaves
enough behind it (prefix and position filter, both exact), so sets that have only a common passage in one cell don't meet, and no cell loses
a link.  The order is any fixed one; how frequent a shingle is comes from a sample of the sets, which changes the work but no result.

With ``simhash`` the fingerprints of ``callweave.llm.simhash`` come first: texts within two bits are proposed and verified likewise, and the
bands compare only what that has not joined.

Null text and text without words have the empty set and are one group.  Repeated rows are rows of the result each.  A null id belongs
to its component but is not its smallest id.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import LOWER, chunks, mix, owners, run_hashes, text_bytes, word_hashes, words
from callweave.llm.components import components
from callweave.llm.simhash import fingerprints_of, near_links
from callweave.session import cut

BANDS, ROWS = 32, 4
CROWDED, SMALL = 4, 16
SAMPLE, FREQUENT = 2000, 100_000  # sets that tell frequent shingles, and how many of these are told apart
BLOCK = 4096  # sets of a crowded cell that meet the stragglers in one block
SIMILAR = (4, 5)  # at least four fifths
_FLIP, _ODD = np.random.default_rng(20240807).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of each text's distinct shingles in rising order, and the running number of them per text."""
    data, offsets = text_bytes(column)
    starts, ends, before = words(data, offsets)
    counts = np.diff(before)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = np.concatenate([[0], np.cumsum(made)])
    first = np.arange(total[-1]) - np.repeat(total[:-1], made) + np.repeat(before[:-1], made)
    hashes = run_hashes(word_hashes(LOWER[data], starts, ends), first, first + np.repeat(np.minimum(counts, width), made))
    text = owners(total)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(counts)))]).astype(np.int64)


def digests(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """One number per set; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes ^ _ODD[0]), dtype=np.uint64)])
    size = np.diff(total).astype(np.uint64)
    return np.where(size > 0, mix(sums[total[1:]] - sums[total[:-1]] + size), np.uint64(0))


def cells_of(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The 32 cells of each set that is not empty."""
    edges = total[:-1][np.diff(total) > 0]
    cells = np.zeros((len(edges), BANDS), dtype=np.uint64)
    if len(edges):
        for band in range(BANDS):
            cell = np.full(len(edges), band, dtype=np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                cell = mix(cell * _ODD[1] + np.minimum.reduceat((hashes ^ _FLIP[k]) * _ODD[k], edges))
            cells[:, band] = cell
    return cells


def sketched(docs: DataFrame, width: int, key: Column | None, simhash: bool = False) -> DataFrame:
    """(key, doc_id, digest, cells), with ``simhash`` also the fingerprint, fp."""

    def mark(batches):
        for batch in chunks(batches):
            hashes, total = shingle_sets(batch.column("text"), width)
            filled = np.diff(total) > 0
            cells = pa.array(cells_of(hashes, total).ravel().view(np.int64))
            begins = pa.array(np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32))
            columns = {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "digest": pa.array(digests(hashes, total).view(np.int64)),
                       "cells": pa.ListArray.from_arrays(begins, cells)}
            if simhash:
                columns["fp"] = pa.array(fingerprints_of(batch.column("text"), width).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)

    return _picked(docs, key).mapInArrow(mark, "key long, doc_id long, digest long, cells array<long>" + ", fp long" * simhash)


def _picked(docs: DataFrame, key: Column | None) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select((doc_id if key is None else key).alias("key"), doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))


def crowds(cells: DataFrame) -> DataFrame:
    """(cell, digest, n, least) of the cells with company, from the distinct (digest, cell)."""
    counts = cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("least")).where("n > 1"), "counts")
    return cut(cells.join(counts, "cell"), "met")


def proposed(met: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of small cells, and every set of a crowded one with its leaders."""
    few = met.where(F.col("n") <= CROWDED).groupBy("cell").agg(F.collect_list("digest").alias("all"))
    one = few.select("all", F.explode("all").alias("a"))
    pairs = one.select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    many = met.where(F.col("n") > CROWDED)
    company = many.groupBy("digest").agg(F.sum("n").alias("company"))
    ranked = many.join(company, "digest")
    leaders = ranked.groupBy("cell").agg(F.max(F.struct("company", "digest")).alias("top")).select("cell", F.col("top.digest").alias("lead"))
    led = many.join(leaders, "cell").select("digest", F.explode(F.array("lead", "least")).alias("lead")).where("digest <> lead")
    return pairs.union(led.select(F.least("digest", "lead"), F.greatest("digest", "lead"))).distinct()


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of (digest, fp) that tie together what SimHash links, the least digest standing for each fingerprint."""
    least = cut(distinct.groupBy("fp").agg(F.min("digest").alias("b")), "prints")
    equal = distinct.select("fp", F.col("digest").alias("a")).join(least, "fp").select("a", "b")
    left, right = (least.select(F.col("fp").alias(f"fp_{c}"), F.col("b").alias(c)) for c in ("a", "b"))
    linked = near_links(least.select("fp")).toDF("fp_a", "fp_b").join(left, "fp_a").join(right, "fp_b").select("a", "b")
    return equal.union(linked).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two or more of about ``SAMPLE`` sets hold, the ``FREQUENT`` most frequent ones, rising, and their counts."""

    def held(batches):
        for batch in batches:
            for blob in batch.column("set"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob.as_buffer(), dtype=np.int64))], names=["shingle"])

    every = max(1, sets.count() // SAMPLE)
    some = sets.where(F.pmod(F.xxhash64("digest"), F.lit(every)) == 0).select("set").mapInArrow(held, "shingle long")
    found = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingles, counts = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def first_fifth(sets: DataFrame, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(digest, root, loose, size, shingle, left): the rarest fifth of each set's shingles; ``left`` counts a shingle and all behind it."""

    def pick(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column("set")[k].as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                seen = np.where(known[at] == own, counts[at], 0) if len(known) else np.zeros(len(own), dtype=np.int64)
                left = np.arange(len(own), 0, -1)
                left = left[left * SIMILAR[1] >= len(own) * SIMILAR[0]]
                first = own[np.lexsort((mix(own), seen))[: len(left)]]
                rows = pa.array(np.full(len(left), k))
                yield pa.RecordBatch.from_arrays([*batch.select(["digest", "root", "loose"]).take(rows).columns, pa.array(np.full(len(left), len(own))),
                                                  pa.array(first.view(np.int64)), pa.array(left)], names=["digest", "root", "loose", "size", "shingle", "left"])

    return sets.select("digest", "root", "loose", "set").mapInArrow(pick, "digest long, root long, loose boolean, size long, shingle long, left long")


def meeting(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different groups that may be near, of sets (digest, root, loose, set); one of each pair is loose."""
    firsts = cut(first_fifth(sets, *frequent(sets)), "firsts")
    left = firsts.where("loose").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("digest", "root", "size", "left")])
    fits = (F.least("size", "size_a") * SIMILAR[1] >= F.greatest("size", "size_a") * SIMILAR[0]) & (F.col("root") != F.col("root_a"))
    enough = F.least("left", "left_a") * sum(SIMILAR) >= (F.col("size") + F.col("size_a")) * SIMILAR[0]
    pairs = left.join(firsts, "shingle").where(fits & enough & (~F.col("loose") | (F.col("digest_a") < F.col("digest"))))
    return pairs.select(F.least("digest_a", "digest").alias("a"), F.greatest("digest_a", "digest").alias("b")).distinct()


def stragglers(met: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of crowded cells that lie in different groups so far and may still be near.

    ``roots`` holds (node, root), ``sizes`` (digest, size).  One side of each pair lies outside the largest group of its cell.  With the
    sets themselves (``set``) those of cells above ``SMALL`` meet by rare shingles, all others in blocks of the cell.
    """
    named = roots.select(F.col("node").alias("digest"), "root")
    many = met.where(F.col("n") > CROWDED).select("cell", "digest").join(named, "digest", "left").join(sizes.select("digest", "size"), "digest")
    many = cut(many.select("cell", "digest", "size", F.coalesce("root", "digest").alias("root")), "crowded")
    shares = many.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mixed = mixed.where("groups > 1").select("cell", "top", blocks.alias("blocks"), "n")
    open_cells = cut(many.join(mixed, "cell"), "mixed")
    more = None
    if "set" in sizes.columns:
        loose = open_cells.where(F.col("n") > SMALL).groupBy("digest", "root").agg(F.max(F.col("root") != F.col("top")).alias("loose"))
        more, open_cells = meeting(cut(loose.join(sizes, "digest"), "loose")), open_cells.where(F.col("n") <= SMALL)
    left = open_cells.where("root <> top").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                                  F.col("digest").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"))
    right = open_cells.select("cell", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"), F.col("digest").alias("b"),
                              "root", "size", (F.col("root") == F.col("top")).alias("main"))
    fits = (F.least("size", "size_a") * SIMILAR[1] >= F.greatest("size", "size_a") * SIMILAR[0]) & (F.col("root") != F.col("root_a"))
    pairs = left.join(right, ["cell", "block"]).where(fits & (F.col("main") | (F.col("a") < F.col("b"))))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (pairs.union(more) if more is not None else pairs).distinct()


def _near(pairs: DataFrame) -> DataFrame:
    def compare(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(x[k].as_buffer(), dtype=np.uint64) for x in (left, right))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[k] = SIMILAR[1] * common >= SIMILAR[0] * (len(a) + len(b) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(compare, "a long, b long")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides are not in one group yet."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_roots(docs: DataFrame, distinct: DataFrame, width: int, key: Column | None) -> DataFrame:
    """(node, root): the groups of the sets whose similarity is 0.8 or more, by their digests; sets without company are left out."""
    met = crowds(distinct.select("digest", F.explode("cells").alias("cell")))
    pairs = cut(proposed(met), "pairs")
    prints = cut(by_fingerprint(distinct.select("digest", "fp")), "linked") if "fp" in distinct.columns else pairs.limit(0)
    both = pairs.union(prints)
    wanted = both.select("a").union(both.select("b")).distinct().join(distinct.select(F.col("digest").alias("a"), "first_key"), "a").select(F.col("first_key").alias("key"))

    def sets(batches):
        for batch in chunks(batches):
            hashes, total = shingle_sets(batch.column("text"), width)
            blobs = [hashes[a:b].tobytes() for a, b in zip(total[:-1], total[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(digests(hashes, total).view(np.int64)), pa.array(blobs, type=pa.binary())], names=["digest", "set"])

    found = _picked(docs, key).join(wanted, "key", "left_semi").mapInArrow(sets, "digest long, set binary")
    found = cut(found.dropDuplicates(["digest"]), "sets")  # repeated rows share a key
    left, right = (found.select(F.col("digest").alias(c), F.col("set").alias(name)) for c, name in (("a", "left"), ("b", "right")))

    def near(some):
        return _near(some.join(left, "a").join(right, "b").select("a", "b", "left", "right"))

    if "fp" in distinct.columns:
        roots = components(near(prints))
        pairs = apart(pairs, roots)
        roots = components(near(pairs).union(roots))
    else:
        roots = components(near(pairs))
    if met.where(F.col("n") > CROWDED).isEmpty():
        return roots
    more = cut(stragglers(met, roots, found.select("digest", F.octet_length("set").alias("size"), "set")), "stragglers")
    if more.isEmpty():
        return roots
    return components(near(more).union(roots))


def grouped(docs: DataFrame, width: int = 5, key: Column | None = None, simhash: bool = False) -> DataFrame:
    """(key, doc_id, digest, component, component_id): component names the group, component_id is the smallest doc_id in it.

    Texts are linked at a similarity of 0.8 or more; groups are what is reachable over links.
    """
    marked = cut(sketched(docs, width, key, simhash), "sketches")
    ids = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("first_key"))
    ids = cut(ids, "ids")
    prints = ["fp"] if simhash else []
    one = marked.select(F.col("key").alias("first_key"), F.col("digest").alias("_digest"), "cells", *prints).join(ids, "first_key").where("digest = _digest")
    distinct = cut(one.dropDuplicates(["digest"]).select("digest", "first_key", "cells", *prints), "distinct")
    roots = near_roots(docs, distinct, width, key)
    placed = ids.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(least, "root").select(F.col("digest").alias("_digest"), F.col("root").alias("component"), "component_id")
    return marked.join(placed, F.col("digest") == F.col("_digest")).select("key", "doc_id", "digest", "component", "component_id")
