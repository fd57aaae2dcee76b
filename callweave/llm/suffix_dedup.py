"""Exact substring dedup by suffix arrays, built by induced sorting in shards that share no repeat.

Every ``LENGTH``-byte string (window) of a document holds a smallest ``GRAM``-byte gram by hash, its anchor.  Equal windows have equal
anchors, so cutting each text into stretches of windows with one anchor, and dealing the stretches out by anchor, brings equal windows to the
same shard.  Anchors that occur once are dropped first.  A shard folds equal stretches, sorts the suffixes of those that are left by
induced sorting, and reads repeats off the permuted common prefixes.  A stretch that is alone with its anchor shares no window
with another one, so it needs no sorting: its windows repeat if the stretch itself occurs twice.

A gram that stands in very many contexts would send them all to one shard.  Such grams are counted on the way; there are at
most ``MOST_HOT`` of them by their definition (a share of all stretches each), and windows then prefer any other gram as anchor.  Windows
of hot grams only lie wholly in the repeated passage, where equal stretches fold before they are sent.

Null and empty texts have no bytes.  Ids are carried, never compared: repeated rows are documents of their own, so their text repeats.
An empty table gives an empty result.  Matches never cross documents; overlapping ones in one document count.  Texts of any length are
taken whole.  Stretches are told apart by 64-bit hashes.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import byte_codes, chunks, run_hashes, text_bytes
from callweave.llm.exchange import PACKED, blobs_of, packed, partitions, per_key, routed, target, unpacked
from callweave.llm.suffix_array import common_prefixes, suffix_array
from callweave.session import cut

LENGTH = 200
GRAM = 32
MOST_HOT = 1 << 16
LEAST_HOT = 20_000  # stretches; below this no anchor is hot
SHARD_BYTES = 2 << 20  # of text under one suffix array, unless one anchor has more

ASK, KNOWN, SETTLED = 0, 1, 2
ANCHOR = [np.uint64, np.uint64, np.int32, np.uint8]  # gram, key, place, state
MEMBER = [np.uint64, np.uint64, np.int32, np.int32]  # stretch, key, first window, how many in a row
STRETCH = [np.uint64, np.uint64, np.int32, np.int32]  # stretch, gram, bytes, times
RUN = [np.uint64, np.int32, np.int32]  # key, first window, end


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text); the key is one of the row's content, the same in every pass."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return picked.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


class _Stretches:
    """Runs of windows with the same anchor place, in a run of texts."""

    def __init__(self, batch: pa.RecordBatch, hot: np.ndarray, length: int):
        self.data, self.offsets = text_bytes(batch.column("text"))
        self.keys = batch.column("key").to_numpy().view(np.uint64)
        self.codes = byte_codes(self.data)
        self.length, n = length, len(self.data)
        self.first = self.end = self.doc = self.place = np.empty(0, dtype=np.int64)
        self.gram = np.empty(0, dtype=np.uint64)
        if n < length:
            return
        grams = run_hashes(self.codes, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        order = grams
        if len(hot):
            order = (grams >> np.uint64(1)) | (np.isin(grams, hot).astype(np.uint64) << np.uint64(63))
        bits = np.uint64(max(1, (n - 1).bit_length()))
        order = (order >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
        width, span = length - GRAM + 1, 1
        while 2 * span <= width:
            order = np.minimum(order[:-span], order[span:])
            span *= 2
        if span < width:
            order = np.minimum(order[: len(order) - (width - span)], order[width - span:])
        anchor = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        doc = np.searchsorted(self.offsets, np.arange(len(anchor)), side="right") - 1
        fits = np.arange(len(anchor)) + length <= self.offsets[doc + 1]
        start = fits.copy()
        start[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        stop = fits.copy()
        stop[:-1] &= ~fits[1:] | start[1:]
        self.first, self.end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.doc = doc[self.first]
        self.place = (anchor[self.first] - self.offsets[self.doc]).astype(np.int32)
        self.gram = grams[anchor[self.first]]

    def named(self, replies: list) -> np.ndarray:
        """Stretches whose gram a reply names for their document."""
        code = self.gram ^ (self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.searchsorted(self.doc, np.arange(len(replies) + 1))
        wanted = []
        for k, blob in enumerate(replies):
            if blob:
                own = code[at[k]: at[k + 1]]
                wanted.append(own[np.isin(self.place[at[k]: at[k + 1]], np.frombuffer(blob, dtype=np.int32))])
        return np.flatnonzero(np.isin(code, np.concatenate(wanted))) if wanted else np.empty(0, dtype=np.int64)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return first, np.diff(np.append(first, len(ordered)))


def _shared_anchors(keyed: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """Packed (key, place) of anchors that occur more than once; with them all counts that may turn out hot, and the number of stretches."""
    parts = partitions(keyed)

    def ask(batches):
        for batch in chunks(batches):
            found = _Stretches(batch, hot, length)
            keys = found.keys[found.doc]
            order = np.lexsort((keys, found.gram))
            gram, key = found.gram[order], keys[order]
            begin, size = _groups(gram)
            state = np.zeros(len(order), dtype=np.uint8)
            state[np.repeat(size > 1, size)] = SETTLED
            state[begin[size > 1]] = KNOWN
            once = np.ones(len(order), dtype=bool)  # one per gram and document
            once[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
            back = np.argsort(order[once], kind="stable")
            order, state = order[once][back], state[once][back]
            gram, key, place = found.gram[order], keys[order], found.place[order]
            spread = gram + (state == SETTLED).astype(np.uint64) * (key ^ place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            yield packed(target(np.where(state == SETTLED, spread, gram), parts), [gram, key, place, state])

    def answer(batches):
        gram, key, place, state = unpacked(blobs_of(batches), ANCHOR)
        asked = np.flatnonzero(state != SETTLED)
        asked = asked[np.argsort(gram[asked], kind="stable")]
        begin, size = _groups(gram[asked])
        shared = state != ASK
        shared[asked] |= np.repeat(size > 1, size)
        # settled ones count where they are; hot grams are summed from these counts
        grams, counts = np.unique(gram, return_counts=True)
        many = counts * parts >= LEAST_HOT // 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], type=pa.int32()), pa.array([b""], type=pa.binary()), pa.array([grams[many].view(np.int64)], type=pa.list_(pa.int64())),
             pa.array([counts[many]], type=pa.list_(pa.int64())), pa.array([len(gram)], type=pa.int64())], names=["part", "packed", "grams", "counts", "n"])
        out = packed(target(key[shared], parts), [key[shared], place[shared]])
        empty = pa.nulls(out.num_rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), empty, empty, pa.nulls(out.num_rows, pa.int64())],
                                         names=["part", "packed", "grams", "counts", "n"])

    return routed(keyed.mapInArrow(ask, PACKED)).mapInArrow(answer, f"{PACKED}, grams array<long>, counts array<long>, n long")


def _hot_grams(anchors: DataFrame) -> np.ndarray:
    """Grams that stand in so large a share of all stretches that there can be few of them."""
    total = anchors.agg(F.sum("n")).first()[0] or 0
    counts = anchors.select(F.explode(F.arrays_zip("grams", "counts")).alias("c")).groupBy("c.grams").agg(F.sum("c.counts").alias("n"))
    rows = counts.where(F.col("n") > max(LEAST_HOT, total // MOST_HOT)).collect()
    return np.array(sorted(r.grams for r in rows), dtype=np.int64).view(np.uint64)


def repeats(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows also starts elsewhere in these texts."""
    sizes = np.array([len(t) for t in texts])
    whole = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int16) + 2
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    whole[begin[1:] - 1] = 1  # between texts; no byte has this letter
    whole = np.append(whole, np.int16(0))
    order = suffix_array(whole, 258)
    prefix, phi = common_prefixes(whole, order)
    met = prefix >= length
    met[phi[met]] = True
    return [met[a: a + max(0, n - length + 1)] for a, n in zip(begin[:-1], sizes)]


def _repeated_windows(candidates: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """Packed (key, first, end): runs of windows that also start anywhere else."""
    parts = partitions(candidates)

    def deal(batches):
        for batch in chunks(batches):
            found = _Stretches(batch, hot, length)
            live = found.named(batch.column("anchors").to_pylist())
            first, end, gram = found.first[live], found.end[live], found.gram[live]
            kind = run_hashes(found.codes, first, end + length - 1) ^ gram
            key = found.keys[found.doc[live]]
            start = (first - found.offsets[found.doc[live]]).astype(np.int32)
            # the same stretch again and again, one byte on: a run of one letter
            again = np.zeros(len(live), dtype=bool)
            again[1:] = (kind[1:] == kind[:-1]) & (first[1:] == first[:-1] + 1) & (end[1:] == end[:-1] + 1) & (found.doc[live][1:] == found.doc[live][:-1])
            head = np.flatnonzero(~again)
            row = np.diff(np.append(head, len(live))).astype(np.int32)
            members = packed(target(gram[head], parts), [kind[head], key[head], start[head], row])
            once, at, times = np.unique(kind, return_index=True, return_counts=True)
            size = (end - first)[at].astype(np.int32) + np.int32(length - 1)
            where = target(gram[at], parts)
            stretches = packed(where, [once, gram[at], size, times.astype(np.int32)])
            data = found.data.tobytes()
            rank = np.argsort(where, kind="stable")
            edges = np.append(_groups(where[rank])[0], len(rank))
            texts = [b"".join(data[a: a + n] for a, n in zip(first[at][rank[x:y]].tolist(), size[rank[x:y]].tolist())) for x, y in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([members.column(0), members.column(1), pa.nulls(members.num_rows, pa.binary()), pa.nulls(members.num_rows, pa.binary())],
                                             names=["part", "packed", "stretches", "texts"])
            yield pa.RecordBatch.from_arrays([stretches.column(0), pa.nulls(stretches.num_rows, pa.binary()), stretches.column(1), pa.array(texts, type=pa.binary())],
                                             names=["part", "packed", "stretches", "texts"])

    def sort(batches):
        member_blobs, known = [], {}
        for batch in batches:
            for members, stretches, texts in zip(*(batch.column(c).to_pylist() for c in ("packed", "stretches", "texts"))):
                if members is not None:
                    member_blobs.append(members)
                    continue
                at = 0
                for kind, gram, size, times in zip(*(x.tolist() for x in unpacked([stretches], STRETCH))):
                    have = known.get(kind)
                    known[kind] = (gram, texts[at: at + size], times) if have is None else (have[0], have[1], have[2] + times)
                    at += size
        gone: dict[int, np.ndarray] = {}
        for shard in _shards(known):
            for (kind, (_, text, times)), met in zip(shard, repeats([t for _, (_, t, _) in shard], length) if len(shard) > 1 else [None]):
                gone[kind] = np.ones(len(text) - length + 1, dtype=bool) if times > 1 else met
        kinds, firsts, ends = [], [], []
        for kind, met in gone.items():
            if met is not None and met.any():
                edge = np.diff(np.concatenate([[0], met.astype(np.int8), [0]]))
                a = np.flatnonzero(edge > 0)
                kinds.append(np.full(len(a), kind, dtype=np.uint64))
                firsts.append(a)
                ends.append(np.flatnonzero(edge < 0))
        if not kinds:
            return
        kinds, firsts, ends = (np.concatenate(x) for x in (kinds, firsts, ends))
        rank = np.argsort(kinds, kind="stable")
        kinds, firsts, ends = kinds[rank], firsts[rank], ends[rank]
        for blob in member_blobs:  # replies run by run, so that memory follows one run
            kind, key, start, row = unpacked([blob], MEMBER)
            low, high = np.searchsorted(kinds, kind, side="left"), np.searchsorted(kinds, kind, side="right")
            n = high - low
            which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start, row, key = np.repeat(start, n), np.repeat(row, n), np.repeat(key, n)
            yield packed(target(key, parts), [key, (start + firsts[which]).astype(np.int32), (start + ends[which] + row - 1).astype(np.int32)])

    schema = "part int, packed binary, stretches binary, texts binary"
    return routed(candidates.mapInArrow(deal, schema)).mapInArrow(sort, PACKED)


def _shards(known: dict):
    """Stretches of equal anchors together; those alone with their anchor one by one, the others in shards of bounded size."""
    ranked = sorted(known.items(), key=lambda item: item[1][0])
    shard, size, k = [], 0, 0
    while k < len(ranked):
        end = k + 1
        while end < len(ranked) and ranked[end][1][0] == ranked[k][1][0]:
            end += 1
        if end == k + 1:
            yield ranked[k: end]
        else:
            shard += ranked[k: end]
            size += sum(len(item[1][1]) for item in ranked[k: end])
            if size >= SHARD_BYTES:
                yield shard
                shard, size = [], 0
        k = end
    if shard:
        yield shard


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, kept (its bytes that stay), n_bytes, n_removed, n_spans."""
    keyed = _keyed(docs)
    hot = np.empty(0, dtype=np.uint64)
    anchors = cut(_shared_anchors(keyed, hot, length), "anchors")
    hot = _hot_grams(anchors)
    if len(hot):
        anchors = cut(_shared_anchors(keyed, hot, length), "anchors")

    def places(batches):
        yield per_key(*unpacked(blobs_of(batches), [np.uint64, np.int32]), "_key", "anchors")

    def runs(batches):
        key, first, end = unpacked(blobs_of(batches), RUN)
        yield per_key(key, np.stack([first, end], axis=1), "_key", "gone")

    shared = routed(anchors.where("part >= 0").select("part", "packed")).mapInArrow(places, "_key long, anchors binary")
    candidates = keyed.join(shared.hint("shuffle_hash"), F.col("key") == F.col("_key")).select("key", "doc_id", "text", "anchors")
    gone = routed(_repeated_windows(candidates, hot, length)).mapInArrow(runs, "_key long, gone binary")
    # The same exchange of the texts serves this join and the one above.
    rows = keyed.join(gone.hint("shuffle_hash"), F.col("key") == F.col("_key"), "left").select("key", "doc_id", "text", "gone")

    def strip(batches):
        for batch in chunks(batches):
            data, offsets = text_bytes(batch.column("text"))
            marks = np.zeros(len(data) + 1, dtype=np.int64)
            for base, blob in zip(offsets[:-1], batch.column("gone").to_pylist()):
                if blob:
                    first, end = np.frombuffer(blob, dtype=np.int32).reshape(-1, 2).T.astype(np.int64)
                    np.add.at(marks, base + first, 1)
                    np.add.at(marks, base + end - 1 + length, -1)
            removed = np.cumsum(marks[:-1]) > 0
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            begins[inner] |= removed[inner]
            total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, begins))
            kept = [data[a:b][~removed[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, type=pa.binary()), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets]))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(strip, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
