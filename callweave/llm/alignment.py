"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often over the corpus.

Each text is encoded by both tokenizers; where a token of one and a token of the other end at the same byte they are linked, and
these ends cut both sequences into groups.  Links go into an inverted index: per pair of ids a bitmap of documents, in planes (a
document's bit is set in plane k if bit k of its number of such links is).  The index comes in segments of at most 65536 documents.
The bitmaps of the runs of texts that make a segment are OR-merged into one per pair and plane, kept as a sorted list of documents
where that is smaller.  Popcounts give documents and links per pair, summed over segments; the postings hand the scores back to
their documents.

Null and empty texts, and texts that the tokens of either side do not spell byte for byte, have no tokens: zeros and ''.  Repeated rows count
each for itself; ids may be null; ties for the highest count all win.  Columns of any name may stand beside id and text.  An empty
table gives no rows.  A text of any length is encoded whole and lies in one segment.  Special tokens' strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.batches import chunks
from callweave.session import cut

SEGMENT_BYTES = 8 << 20
SEGMENT_DOCS = 1 << 16
RUN_BYTES = 1 << 20

PLANES = "array<struct<counts: binary, docs: binary, bits: binary>>"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def vocabularies() -> tuple[str, str, str]:
    """Ranks and json of the byte-level vocabulary (A), model of the pieces (B)."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


class Encoders:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, ranks: str, json: str, model: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.json, self.whole = json, None
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_a[rank] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode("utf-8") for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        most = max(len(pieces), len(self.bytes_a))
        self.names = [b"%d%s" % (k, end) for k in range(most) for end in (b",", b"|", b";")]

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the pattern engine gives up on very long runs of blanks; the same vocabulary without it is slower
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json)
                self.whole.encode_special_tokens = True
            return self.whole.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoders] = {}


def _encoder(paths: tuple[str, str, str]) -> Encoders:
    if paths not in _encoders:
        _encoders[paths] = Encoders(*paths)
    return _encoders[paths]


def links(texts: list[str | None], paths: tuple[str, str, str]) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text, groups as text, and text, A id and B id of each link."""
    enc = _encoder(paths)
    n = len(texts)
    ids_a, ids_b = [[]] * n, [[]] * n
    full = [k for k, t in enumerate(texts) if t]
    for k, own in zip(full, enc.b.encode([texts[k] for k in full], num_threads=1) if full else []):
        spaced = " " + texts[k]
        plain, first = spaced.encode("utf-8"), enc.encode_a(spaced)
        if b"".join(map(enc.bytes_a.__getitem__, first)) == plain == b"".join(map(enc.bytes_b.__getitem__, own)):
            ids_a[k], ids_b[k] = first, own
    count_a, count_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (ids_a, ids_b))
    a, b = (np.array([i for x in side for i in x], dtype=np.int64) for side in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(enc.length_a[a]), np.cumsum(enc.length_b[b])
    at = np.searchsorted(ends_b, ends_a)
    meet_a = ends_b[at] == ends_a if len(a) else np.zeros(0, dtype=bool)
    meet_b = np.zeros(len(b), dtype=bool)
    meet_b[at[meet_a]] = True
    group_a, group_b = np.cumsum(meet_a) - meet_a, np.cumsum(meet_b) - meet_b
    groups = int(meet_a.sum())
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a * 3 + meet_a
    codes[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b * 3 + 2 * meet_b
    text_a = np.repeat(np.arange(n), count_a)
    owner = text_a[meet_a]
    n_links = np.bincount(owner, minlength=n)
    stops = np.cumsum(count_a + count_b).tolist()
    listed = codes.tolist()
    written = [b"".join(map(enc.names.__getitem__, listed[x:y]))[:-1] for x, y in zip([0, *stops[:-1]], stops)]
    return {"n_a": count_a, "n_b": count_b, "n_groups": n_links, "n_links": n_links}, written, owner, a[meet_a], b[at[meet_a]]


# --- bitmaps ---------------------------------------------------------------------------
def merged(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_pairs: int, n_docs: int) -> list[dict[str, bytes]]:
    """Planes over postings (pair, document, number of links), each (pair, document) once."""
    order = np.argsort(pair * n_docs + doc)
    pair, doc, times = pair[order], doc[order], times[order]
    width, planes = -(-n_docs // 8), []
    for k in range(int(times.max()).bit_length() if len(times) else 0):
        here = (times >> k & 1).astype(bool)
        own, docs = pair[here], doc[here]
        counts = np.bincount(own, minlength=n_pairs)
        full = counts * 2 > width  # a list of two bytes a document would be longer than the bitmap
        row = np.cumsum(full) - 1
        bits = np.zeros((int(full.sum()), width), dtype=np.uint8)
        dense = full[own]
        np.bitwise_or.at(bits, (row[own[dense]], docs[dense] >> 3), (1 << (docs[dense] & 7)).astype(np.uint8))
        planes.append({"counts": counts.astype("<u4").tobytes(), "docs": docs[~dense].astype("<u2").tobytes(), "bits": bits.tobytes()})
    return planes


def postings(plane: dict[str, bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, document) of every bit of a plane."""
    counts, width = np.frombuffer(plane["counts"], dtype="<u4").astype(np.int64), -(-n_docs // 8)
    full = np.flatnonzero(counts * 2 > width)
    thin = counts.copy()
    thin[full] = 0
    pair, doc = [np.repeat(np.arange(len(counts)), thin)], [np.frombuffer(plane["docs"], dtype="<u2").astype(np.int64)]
    bits = np.frombuffer(plane["bits"], dtype=np.uint8).reshape(len(full), width)
    for k in range(0, len(full), 64):
        rows, docs = np.nonzero(np.unpackbits(bits[k: k + 64], axis=1, bitorder="little"))
        pair.append(full[k + rows])
        doc.append(docs)
    return np.concatenate(pair), np.concatenate(doc)


def popcounts(plane: dict[str, bytes], n_docs: int) -> np.ndarray:
    counts, width = np.frombuffer(plane["counts"], dtype="<u4").astype(np.int64), -(-n_docs // 8)
    full = counts * 2 > width
    counts[full] = np.bitwise_count(np.frombuffer(plane["bits"], dtype=np.uint8).reshape(-1, width)).sum(axis=1, dtype=np.int64)
    return counts


# --- jobs ------------------------------------------------------------------------------
def index(docs: DataFrame, ident: str = "doc_id", paths: tuple[str, str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """Segments: their documents with counts and groups, the pairs that occur and the planes of each."""
    paths = paths or vocabularies()
    rows = docs.select(F.col(ident).alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    written = ", groups: string" if with_groups else ""
    schema = (f"segment bigint, docs array<struct<id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string{written}>>, "
              f"pairs binary, planes {PLANES}")

    def run(batches):
        held: dict[str, list] = {}
        size, part, number = 0, TaskContext.get().partitionId(), 0

        def segment():
            nonlocal held, size, number
            n_docs = sum(len(x) for x in held["ids"])
            keys, pair = np.unique(np.concatenate(held["key"]), return_inverse=True)
            planes = merged(pair, np.concatenate(held["doc"]), np.concatenate(held["times"]), len(keys), n_docs)
            columns = [pa.chunked_array(held["ids"]).combine_chunks(), *[pa.array(np.concatenate([c[name] for c in held["counts"]])) for name in COUNTS],
                       pa.array([x for run in held["sha"] for x in run], pa.string())]
            names = ["id", *COUNTS, "groups_sha256"]
            if with_groups:
                columns.append(pa.array([x for run in held["text"] for x in run], pa.string()))
                names.append("groups")
            listed = pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), pa.StructArray.from_arrays(columns, names))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), listed, pa.array([keys.astype("<i8").tobytes()], pa.binary()),
                 pa.array([planes], pa.list_(pa.struct([("counts", pa.binary()), ("docs", pa.binary()), ("bits", pa.binary())])))],
                names=["segment", "docs", "pairs", "planes"])
            held, size, number = {}, 0, number + 1
            return out

        for piece in chunks(batches, most=RUN_BYTES):
            for base in range(0, piece.num_rows, SEGMENT_DOCS // 2):
                few = piece.slice(base, SEGMENT_DOCS // 2)
                before = sum(len(x) for x in held.get("ids", []))
                if held and (size >= SEGMENT_BYTES or before + few.num_rows > SEGMENT_DOCS):
                    yield segment()
                    before = 0
                counts, groups, owner, a, b = links(few.column("text").to_pylist(), paths)
                once, times = _distinct(a << 32 | b, owner)
                for name, value in (("ids", few.column("id")), ("counts", counts), ("key", once[0]), ("doc", once[1] + before), ("times", times),
                                    ("sha", [hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                                    ("text", [g.decode() for g in groups] if with_groups else [])):
                    held.setdefault(name, []).append(value)
                size += few.column("text").nbytes
        if held:
            yield segment()

    return rows.mapInArrow(run, schema)


def _distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)])
    return np.stack([key[first], owner[first]]), np.diff(np.append(first, len(key)))


def segment_pairs(segments: DataFrame) -> DataFrame:
    """(segment, a, b, n_docs, n_links) by popcount."""

    def run(batches):
        for batch in batches:
            for name, pairs, planes, n_docs in zip(*[batch.column(c).to_pylist() for c in ("segment", "pairs", "planes", "n")]):
                keys = np.frombuffer(pairs, dtype="<i8")
                n_links = sum((popcounts(p, n_docs) << k for k, p in enumerate(planes)), np.zeros(len(keys), dtype=np.int64))
                either = [x * n_docs + d for x, d in (postings(p, n_docs) for p in planes)]  # OR over the planes
                in_docs = np.bincount(np.unique(np.concatenate(either)) // n_docs, minlength=len(keys)) if either else n_links
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.int64()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(in_docs.astype(np.int64)), pa.array(n_links)], names=["segment", "a", "b", "n_docs", "n_links"])

    narrow = segments.select("segment", "pairs", "planes", F.size("docs").alias("n"))
    return narrow.mapInArrow(run, "segment bigint, a int, b int, n_docs bigint, n_links bigint")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): ``best`` where no other A id has more links with the B id."""
    sums = found.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    return sums.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def aligned(docs: DataFrame, ident: str = "doc_id", paths: tuple[str, str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, [groups,] n_best, count_sum."""
    segments = cut(index(docs, ident, paths, with_groups), "segments")
    found = cut(segment_pairs(segments), "segment_pairs")
    scores = found.select("segment", "a", "b").join(pair_counts(found), ["a", "b"]).select("segment", "a", "b", "n_links", "best")
    rows = segments.schema["docs"].dataType.elementType
    names = [f.name for f in rows.fields]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        listed, planes = left.column("docs").combine_chunks().flatten(), left.column("planes")[0].as_py()
        n_docs, keys = len(listed), np.frombuffer(left.column("pairs")[0].as_py(), dtype="<i8")
        own = right.column("a").to_numpy().astype(np.int64) << 32 | right.column("b").to_numpy()
        count, best = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        at = np.searchsorted(keys, own)
        count[at], best[at] = right.column("n_links").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
        for k, plane in enumerate(planes):
            pair, doc = postings(plane, n_docs)
            np.add.at(n_best, doc, best[pair] << k)
            np.add.at(count_sum, doc, count[pair] << k)
        return pa.table([*listed.flatten(), pa.array(n_best), pa.array(count_sum)], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.fields) + ", n_best bigint, count_sum bigint"
    back = segments.groupBy("segment").cogroup(scores.groupBy("segment")).applyInArrow(score, schema)
    return back.withColumnRenamed("id", ident)
