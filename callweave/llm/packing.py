"""Packing token sequences: documents in sequences of a fixed capacity, few of them cut, no padding.

A document is its token ids and an end id.  It is cut into pieces of ``capacity`` and a remainder; the histogram of piece lengths, at
most ``capacity`` numbers, gives the patterns (``cutting_stock``), and each piece finds its place from its length and its rank among
the pieces of that length.  Pieces that no pattern takes lie on a stream, whose cuts fill what patterns leave free and then
sequences of their own; the last ones are powers of two.

Null and empty texts are the end id alone.  Repeated rows are packed each for itself; ranks follow the order of rows in the table, so ties
need no rule.  Ids may be null and columns of any name may stand beside them: only id and text are read.  A text of any length is tokenised
whole, and a document of n tokens is n / capacity rows.  An empty table gives no rows.

Ranks are counted in two levels (within a task, then over tasks), the plan of places is bounded by the capacity, and the ids
themselves are read again only for pieces on the stream.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import cutting_stock
from callweave.session import cut

CAPACITY = 2048
END = 1
MOST_WORDS = 400_000  # words a task remembers, and as many older ones that it may come back to

_SIMPLE = re.compile("[!-~à-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[^a-z0-9à-öø-ÿ]+")
_CODE = "part int, idx bigint, id {id}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, rank bigint, ids binary"
_PLACED = "part int, idx bigint, id {id}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Token ids (little-endian unsigned 32 bits) of white-space separated words, worked out once each.

    The tokenizer splits at white space, lower-cases and knows no token across words, so a text's ids are those of its words.  Words of
    plain Latin letters, digits and signs are split here and looked up in the model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8")
            if word.isalpha():  # ASCII letters: one piece of the pattern
                ids = [t.id for t in self.model.tokenize(text.lower())]
            elif _SIMPLE.fullmatch(text) and not ("<" in text and any(s in text for s in self.specials)):
                ids = [t.id for piece in _PIECE.findall(text.lower()) for t in self.model.tokenize(
                    piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode("utf-8"))))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found


_vocabularies: dict[str, WordIds] = {}


def token_ids(text: bytes, path: str) -> bytes:
    if path not in _vocabularies:
        _vocabularies[path] = WordIds(path)
    return b"".join(map(_vocabularies[path].__getitem__, text.split()))


def encoded(docs: DataFrame, ident: str, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` tokens with their ids; ``rank`` counts pieces of a length within ``part``."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        part, seen, idx = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64).tolist(), 0
        for batch in batches:
            for base in range(0, batch.num_rows, 256):
                few = batch.slice(base, 256)
                owner, rows = [], []
                for k, text in enumerate(few.column("text").cast(pa.binary()).to_pylist()):
                    ids = token_ids(text or b"", path) + tail
                    for start in range(0, len(ids), 4 * capacity):
                        piece = ids[start: start + 4 * capacity]
                        length = len(piece) // 4
                        owner.append(k)
                        rows.append((idx, start // 4, length, len(ids) // 4, zlib.crc32(piece), seen[length], piece))
                        seen[length] += 1
                        idx += 1
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows), pa.int32()), pa.array(columns[0], pa.int64()), few.column("id").take(pa.array(owner)),
                         *[pa.array(c, pa.int64()) for c in columns[1:6]], pa.array(columns[6], pa.binary())],
                        names=["part", "idx", "id", "start", "length", "doc_tokens", "ids_crc32", "rank", "ids"])

    rows = docs.select(F.col(ident).alias("id"), "text")
    return rows.mapInArrow(run, _CODE.format(id=rows.schema["id"].dataType.simpleString()))


def packed(docs: DataFrame, ident: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece, with ``ids`` (little-endian unsigned 32 bits) on demand."""
    table = cut(encoded(docs, ident, path or vocabulary(), capacity, end), "pieces")
    counts = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("own"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("own").alias("n")).collect()}  # at most ``capacity`` rows
    plan = cutting_stock.layout(totals, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("shift"))
    kind = table.schema["id"].dataType.simpleString()
    ranked = table.drop("ids").join(shifts, ["part", "length"]).select(
        "part", "idx", "id", "start", "length", "doc_tokens", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))

    def place(batches):
        for batch in batches:
            sequence, offset, _ = cutting_stock.places(plan, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:7], "sequence_id", "offset"])

    def slices(batches):
        for batch in batches:
            owner, rows = [], []
            for k, (start, length, sequence, offset, ids) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("start", "length", "sequence_id", "offset", "ids")])):
                for first, take, into, at in [(0, length, sequence, offset)] if sequence >= 0 else cutting_stock.stretches(plan, offset, length):
                    own = ids[4 * first: 4 * (first + take)]
                    owner.append(k)
                    rows.append((start + first, take, zlib.crc32(own), into, at, own))
            if rows:
                start, length, crc, into, at, own = zip(*rows)
                ident, tokens = (batch.column(c).take(pa.array(owner)) for c in ("id", "doc_tokens"))
                yield pa.RecordBatch.from_arrays(
                    [ident, *[pa.array(c, pa.int64()) for c in (start, length, crc)], tokens, pa.array(into, pa.int64()), pa.array(at, pa.int64()), pa.array(own, pa.binary())],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = cut(ranked.mapInArrow(place, _PLACED.format(id=kind)), "placed")
    result = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    read = placed if with_ids else placed.where("sequence_id < 0")
    found = read.join(table.select("part", "idx", "ids"), ["part", "idx"]).mapInArrow(slices, result)
    if not with_ids:
        found = found.drop("ids")
        found = placed.where("sequence_id >= 0").select(*found.columns).unionByName(found)
    return found.withColumnRenamed("id", ident)
