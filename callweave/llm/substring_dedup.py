"""Substring dedup by difference-cover anchors.

A window is ``length`` consecutive words of a document; a word goes if a window over it also starts in a document with a
smaller id.  Two equal windows need not start at the same place modulo anything, but a difference cover D of the residues
modulo a period holds, for any two places, a common shift that moves both into D.  So only shorter runs (anchors) at cover
places are hashed and exchanged: equal windows contain equal, aligned anchors.  Only around anchors that occur in two documents the
match is extended to whole windows, which are hashed and exchanged in turn; the smallest document of each keeps it.

An anchor or window that one run of texts holds many times is settled there and sent once, so a passage shared by
thousands of documents costs one record per run of texts.  Texts are shuffled once, by a key of their own; nothing is collected.

Windows are compared by 64-bit hashes of 64-bit word hashes.  Null and empty texts have no words.  A null id counts as larger
than every id.  Rows with equal ids do not count as smaller than each other; equal rows get equal results.  An empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import chunks, cover_runs, owners, run_hashes, text_bytes, word_hashes, words
from callweave.llm.exchange import PACKED, blobs_of, packed, partitions, per_key, routed, target, unpacked

LENGTH = 50
# A difference cover of the residues modulo 31 (every residue is a difference of two members).
PERIOD = 31
COVER = [1, 5, 11, 24, 25, 27]
NO_ID = np.iinfo(np.int64).max


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text); the key is one of the row's content, the same in every pass."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return picked.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


class _Words:
    """The words of a run of texts: bounds, hashes, owners and places within their document."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, offsets = text_bytes(batch.column("text"))
        self.starts, self.ends, self.before = words(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.doc = owners(self.before)
        self.place = np.arange(len(self.doc)) - self.before[:-1][self.doc]
        self.counts = np.diff(self.before)
        self.keys = batch.column("key").to_numpy().view(np.uint64)

    def runs(self, first: np.ndarray, length: int) -> np.ndarray:
        return run_hashes(self.hashes, first, first + length)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors, and their hashes."""
        short = length - PERIOD + 1
        mine = np.zeros(PERIOD, dtype=bool)
        mine[COVER] = True
        fits = (self.counts[self.doc] >= length) & (self.place + short <= self.counts[self.doc]) & mine[self.place % PERIOD]
        first = np.flatnonzero(fits)
        return first, self.runs(first, short)

    def spread(self, replies: list) -> np.ndarray:
        """Word numbers named by the replies: packed places per text, or none."""
        found = [np.frombuffer(blob, dtype=np.int32) + base for base, blob in zip(self.before[:-1], replies) if blob]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def alike(self, first: np.ndarray, hashes: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Those of ``first`` that have the hash of a named place in the same document."""
        code = hashes ^ (self.doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return first[np.isin(code, code[np.searchsorted(first, named)])]


def _once(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The first of each pair (hash, key), sorted by hash, then by place."""
    order = np.lexsort((keys, hashes))
    h, k = hashes[order], keys[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    return order[new]


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal values, and its length."""
    if not len(sorted_values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.append(first, len(sorted_values)))


ASK, KNOWN, SETTLED = 0, 1, 2
ANCHOR = [np.uint64, np.uint64, np.int32, np.uint8]  # hash, key, place, state
WINDOW = [np.uint64, np.int64, np.uint64, np.int32, np.uint8]  # hash, id, key, place, state


def _shared_anchors(keyed: DataFrame, length: int) -> DataFrame:
    """Packed (key, place) of the anchors that also occur in another document."""
    parts = partitions(keyed)

    def ask(batches):
        for batch in chunks(batches):
            text = _Words(batch)
            first, hashes = text.anchors(length)
            keys = text.keys[text.doc[first]]
            once = _once(hashes, keys)
            begin, size = _groups(hashes[once])
            state = np.zeros(len(once), dtype=np.uint8)
            state[np.repeat(size > 1, size)] = SETTLED
            state[begin[size > 1]] = KNOWN  # one of them asks on behalf of the run
            back = np.argsort(once, kind="stable")  # in order of documents, which packs best
            once, state = once[back], state[back]
            place = text.place[first[once]].astype(np.int32)
            where = np.where(state == SETTLED, target(keys[once] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts), target(hashes[once], parts))
            yield packed(where, [hashes[once], keys[once], place, state])

    def answer(batches):
        hashes, keys, places, state = unpacked(blobs_of(batches), ANCHOR)
        order = np.argsort(np.where(state == SETTLED, np.uint64(0), hashes), kind="stable")
        asked = order[state[order] != SETTLED]
        begin, size = _groups(hashes[asked])
        shared = np.zeros(len(hashes), dtype=bool)
        several = _several(keys[asked], begin, size)
        shared[asked] = np.repeat(several, size)
        shared |= state != ASK
        yield packed(target(keys[shared], parts), [keys[shared], places[shared]])

    return routed(keyed.mapInArrow(ask, PACKED)).mapInArrow(answer, PACKED)


def _several(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which groups hold more than one distinct value."""
    if not len(begin):
        return np.empty(0, dtype=bool)
    return np.maximum.reduceat(values, begin) != np.minimum.reduceat(values, begin)


def _gathered(replies: DataFrame, name: str) -> DataFrame:
    """One row per document that is named in packed replies, with all its places."""

    def collect(batches):
        keys, places = unpacked(blobs_of(batches), [np.uint64, np.int32])
        yield per_key(keys, places, "_key", name)

    return routed(replies).mapInArrow(collect, f"_key long, {name} binary")


def _repeated_windows(candidates: DataFrame, length: int) -> DataFrame:
    """Packed (key, place) of the windows that start in a document with a smaller id as well."""
    parts = partitions(candidates)

    def ask(batches):
        for batch in chunks(batches):
            text = _Words(batch)
            first, hashes = text.anchors(length)
            live = text.alike(first, hashes, text.spread(batch.column("anchors").to_pylist()))
            starts = text.counts - length  # last place where a window starts
            place = text.place[live]
            low, high = np.maximum(place - PERIOD + 1, 0), np.minimum(place, starts[text.doc[live]])
            marks = np.zeros(len(text.doc) + 1, dtype=np.int64)
            np.add.at(marks, live - place + low, 1)
            np.add.at(marks, live - place + high + 1, -1)
            window = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            hashes = text.runs(window, length)
            doc = text.doc[window]
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()[doc]
            keys = text.keys[doc]
            once = _once(hashes, keys)
            begin, size = _groups(hashes[once])
            least = np.repeat(np.minimum.reduceat(ids[once], begin) if len(begin) else begin, size)
            state = np.where(ids[once] > least, SETTLED, ASK).astype(np.uint8)
            back = np.argsort(once, kind="stable")
            once, state = once[back], state[back]
            place = text.place[window[once]].astype(np.int32)
            where = np.where(state == SETTLED, target(keys[once] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts), target(hashes[once], parts))
            yield packed(where, [hashes[once], ids[once], keys[once], place, state])

    def answer(batches):
        hashes, ids, keys, places, state = unpacked(blobs_of(batches), WINDOW)
        asked = np.flatnonzero(state == ASK)
        asked = asked[np.argsort(hashes[asked], kind="stable")]
        begin, size = _groups(hashes[asked])
        gone = state == SETTLED
        if len(begin):
            gone[asked] = ids[asked] > np.repeat(np.minimum.reduceat(ids[asked], begin), size)
        yield packed(target(keys[gone], parts), [keys[gone], places[gone]])

    return routed(candidates.mapInArrow(ask, PACKED)).mapInArrow(answer, PACKED)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The given words with a blank after each, and where each begins (one more for the end)."""
    size = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(starts - begin[:-1], size) + np.arange(begin[-1])
    out = data[np.minimum(source, max(len(data) - 1, 0))] if len(data) else np.empty(0, dtype=np.uint8)
    out[begin[1:] - 1] = 0x20
    return out.tobytes(), begin


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, kept (its words that stay, joined by a blank), n_words, n_removed."""
    keyed = _keyed(docs)
    anchors = _gathered(_shared_anchors(keyed, length), "anchors")
    candidates = keyed.join(anchors.hint("shuffle_hash"), F.col("key") == F.col("_key")).select("key", "doc_id", "text", "anchors")
    gone = _gathered(_repeated_windows(candidates, length), "gone")
    # The same exchange of the texts serves this join and the one above.
    rows = keyed.join(gone.hint("shuffle_hash"), F.col("key") == F.col("_key"), "left").select("key", "doc_id", "text", "gone")

    def strip(batches):
        for batch in chunks(batches):
            text = _Words(batch)
            named = text.spread(batch.column("gone").to_pylist())
            keep = np.ones(len(text.doc), dtype=bool)
            if len(named):
                window = np.flatnonzero(text.place <= text.counts[text.doc] - length)
                again = text.alike(window, text.runs(window, length), named)
                keep = ~cover_runs(again, length, len(keep))
            flat, begin = joined_words(text.data, text.starts[keep], text.ends[keep])
            upto = np.concatenate([[0], np.cumsum(keep)])[text.before]
            kept = [flat[begin[a]: max(begin[a], begin[b] - 1)] for a, b in zip(upto[:-1], upto[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, type=pa.binary()).cast(pa.string()), pa.array(text.counts), pa.array(text.counts - np.diff(upto))],
                names=["doc_id", "kept", "n_words", "n_removed"])

    return rows.mapInArrow(strip, "doc_id long, kept string, n_words long, n_removed long")
