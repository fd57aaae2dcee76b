"""Benchmark decontamination on a positional inverted index.

``build_index`` stores the postings of the training texts: per shard of whole documents the sorted terms and, for each, the
positions of its occurrences.  ``phrase_hits`` takes the test items as windows of words and finds where they occur: the rarest
term of a window supplies candidate places, which are intersected with the lists of its other terms, rarest first, each moved by
the term's offset.  With ``slop`` the lists may be off by that many words (proximity matches); 0 asks for exact phrases.

Test items are a query set: they go to the shards in blocks of bounded size, one pass over the index for each.  A window of
frequent words only costs its rarest list, worked through in runs of bounded length.

Null text has no words; such documents and those of an empty table of items come back without hits.  A null item_id hits words
but is not listed.  Repeated documents are judged row by row, repeated item ids count once.  Equal windows are looked up once.
Very long documents are a shard of their own.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import LOWER, chunks, text_bytes, word_hashes, words
from callweave.session import cut

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_WINDOWS = 1 << 17  # windows of test items sent to the shards at once: 14 MB
CANDIDATES = 1 << 20  # places examined at once in a shard

TERM_BYTE = np.zeros(256, dtype=bool)
TERM_BYTE[48:58] = TERM_BYTE[97:123] = TERM_BYTE[128:] = True

INDEX = "shard long, doc_ids array<long>, doc_words binary, terms binary, counts binary, positions binary"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased terms and the running number of terms before each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, before = words(data, offsets, TERM_BYTE)
    return word_hashes(data, starts, ends), before


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: its documents with their word counts, and the postings of its terms."""

    def post(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, most=SHARD_BYTES):
            hashes, before = _terms(batch.column("text"))
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, dtype=np.int64)
            counts = np.diff(np.append(first, len(ranked)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([batch.column("doc_id").to_pylist()], type=pa.list_(pa.int64())),
                 pa.array([before.astype(np.int64).tobytes()]), pa.array([ranked[first].tobytes()]),
                 pa.array([counts.astype(np.int32).tobytes()]), pa.array([order.astype(np.int32).tobytes()])],
                names=["shard", "doc_ids", "doc_words", "terms", "counts", "positions"])
            shard += 1

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(post, INDEX)


def windows_of(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """(item_id, terms): the runs of ``length`` words of each item; a shorter item is one run."""

    def split(batches):
        for batch in chunks(batches):
            hashes, before = _terms(batch.column("text"))
            ids, runs = [], []
            for item, a, b in zip(batch.column("item_id").to_pylist(), before[:-1], before[1:]):
                found = [hashes[i: i + length] for i in range(a, max(a + 1, b - length + 1))] if b > a else []
                runs += [run[: b - a].view(np.int64) for run in found]
                ids += [item] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(runs, type=pa.list_(pa.int64()))], names=["item_id", "terms"])

    picked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(split, "item_id long, terms array<long>")


def _blocks(windows: DataFrame, length: int):
    """The query set in blocks: vocabulary, windows as numbers of terms (-1 beyond the end), and the items of each window."""
    held: dict[tuple, list] = {}
    for row in windows.toLocalIterator():
        held.setdefault(tuple(row.terms), []).append(row.item_id)
        if len(held) >= BLOCK_WINDOWS:
            yield _block(held, length)
            held = {}
    if held:
        yield _block(held, length)


def _block(held: dict[tuple, list], length: int):
    table = np.full((len(held), length), -1, dtype=np.int64)
    vocabulary, numbers = np.unique(np.concatenate([np.array(k, dtype=np.int64) for k in held]).view(np.uint64), return_inverse=True)
    sizes = np.array([len(k) for k in held])
    table[np.repeat(np.arange(len(held)), sizes), np.concatenate([np.arange(n) for n in sizes])] = numbers
    ids = [sorted({i for i in items if i is not None}) for items in held.values()]
    return vocabulary, table, sizes, ids


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def search(doc_words, terms, counts, positions, block, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the block and the place in the shard where each occurs."""
    vocabulary, table, sizes, _ = block
    none = np.empty(0, dtype=np.int64)
    if not len(terms):
        return none, none
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    found = np.where(terms[at] == vocabulary, starts[at + 1] - starts[at], 0)
    lists = np.where(table >= 0, found[table], np.iinfo(np.int64).max)  # list length of each term of each window
    alive = np.flatnonzero(lists.min(axis=1) > 0)
    if not len(alive):
        return none, none
    rarity = np.argsort(lists[alive], axis=1, kind="stable")
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | positions
    load = lists[alive, rarity[:, 0]]
    hits_w, hits_p = [], []
    # A window with a longer list than fits one run is worked through in several.
    runs = -(-load // CANDIDATES)
    window_of = np.repeat(np.arange(len(alive)), runs)
    skip = _spread(runs) * CANDIDATES
    size = np.minimum(load[window_of] - skip, CANDIDATES)
    turn = np.cumsum(size) // CANDIDATES
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(turn)) + 1):
        w = np.repeat(window_of[part], size[part])
        row = alive[w]
        offset = rarity[w, 0]
        term = at[table[row, offset]]
        place = positions[starts[term] + np.repeat(skip[part], size[part]) + _spread(size[part])] - offset
        doc = np.searchsorted(doc_words, place, side="right") - 1
        ok = (doc >= 0) & (doc < len(doc_words) - 1)
        doc = np.where(ok, doc, 0)
        ok &= (place >= doc_words[doc]) & (place + sizes[row] <= doc_words[doc + 1])
        w, row, place, doc = w[ok], row[ok], place[ok], doc[ok]
        for r in range(1, table.shape[1]):
            if not len(w):
                break
            offset = rarity[w, r]
            number = table[row, offset]
            term = at[np.maximum(number, 0)].astype(np.int64) << 32
            low = term + np.maximum(place + offset - slop, doc_words[doc])
            high = term + np.minimum(place + offset + slop, doc_words[doc + 1] - 1)
            near = keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)]
            ok = (number < 0) | ((near >= low) & (near <= high))
            w, row, place, doc = w[ok], row[ok], place[ok], doc[ok]
        hits_w.append(row)
        hits_p.append(place)
    return np.concatenate(hits_w), np.concatenate(hits_p)


def phrase_hits(index: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """(shard, no, hits, items) for the documents with matches: positions of hit words and ids of matching items, may repeat."""
    spark = index.sparkSession
    schema = "shard long, no int, hits array<int>, items array<long>"
    found = None
    for block in _blocks(windows_of(items, length), length):
        sent = spark.sparkContext.broadcast(block)

        def probe(batches, sent=sent):
            block = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {name: batch.column(name)[k].as_py() for name in ("shard", "doc_words", "terms", "counts", "positions")}
                    doc_words = np.frombuffer(row["doc_words"], dtype=np.int64)
                    w, place = search(doc_words, np.frombuffer(row["terms"], dtype=np.uint64), np.frombuffer(row["counts"], dtype=np.int32),
                                      np.frombuffer(row["positions"], dtype=np.int32).astype(np.int64), block, slop)
                    if not len(w):
                        continue
                    doc = np.searchsorted(doc_words, place, side="right") - 1
                    order = np.argsort(doc, kind="stable")
                    nos, first = np.unique(doc[order], return_index=True)
                    hits, ids = [], []
                    for own in np.split(order, first[1:]):
                        n = block[2][w[own]]
                        hits.append(np.unique(np.repeat(place[own] - doc_words[doc[own[0]]], n) + _spread(n)))
                        ids.append(sorted({i for x in np.unique(w[own]) for i in block[3][x]}))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(nos)), pa.array(nos.astype(np.int32)), pa.array(hits, type=pa.list_(pa.int32())),
                         pa.array(ids, type=pa.list_(pa.int64()))], names=["shard", "no", "hits", "items"])

        part = cut(index.select("shard", "doc_words", "terms", "counts", "positions").mapInArrow(probe, schema), "hits")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def marked(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, hits (positions of hit words), items (ids of items with a match, in order)."""
    index = cut(build_index(docs), "index")
    hits = phrase_hits(index, items, length, slop).groupBy("shard", "no").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def listed(batches):
        for batch in batches:
            for shard, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_ids", "doc_words"))):
                n = np.diff(np.frombuffer(counts, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), type=pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)),
                                                  pa.array(ids, type=pa.int64()), pa.array(n)], names=["shard", "no", "doc_id", "n_words"])

    rows = index.select("shard", "doc_ids", "doc_words").mapInArrow(listed, "shard long, no int, doc_id long, n_words long")
    return rows.join(hits, ["shard", "no"], "left").select(
        "doc_id", "n_words", F.coalesce("hits", F.expr("cast(array() as array<int>)")).alias("hits"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"))


def verdicts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document what it shares with the items, and whether that makes up a twentieth of its words or more."""
    n_hit = F.size("hits").cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return marked(docs, items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
