"""Language identification by string kernels.

Two texts are as alike as the n-grams (one to three bytes of lower-cased text, other than letters as blanks) they both contain:
the blended-spectrum presence kernel, normalised.  N-grams are hashed to ``BITS`` places.  A bounded sample of labelled rows gives the
landmarks of a Nyström map; one-versus-rest kernel ridge regression on it gives the weights.  Texts are scored in batches: a
presence matrix times the landmarks times the weights.

The model only sees text and label of rows with a label that are not held out; source and id decide nothing but the fold and which
rows are sampled.  Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row has a label.
A null id is not held out and not learned from.  Repeated rows get equal answers; ties between languages go to the smaller name.
Whole texts count, however long.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.batches import LOWER, chunks, text_bytes

BITS = 13
SPECTRUM = (1, 2, 3)
ROWS_PER_LANGUAGE = 300  # labelled rows the regression is fitted on
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-2
ROWS_AT_ONCE = 256

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: which hashed n-grams it contains."""
    low = LOWER[data]
    code = np.where(_LETTER[low], low, 0x20).astype(np.uint32)
    rows = np.zeros((len(offsets) - 1, 1 << BITS), dtype=np.float32)
    flat = rows.ravel()
    for n in SPECTRUM:
        if len(code) < n:
            continue
        gram = np.full(len(code) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            gram = gram * np.uint32(0x01000193) + code[k: len(code) - n + 1 + k]
        gram *= np.uint32(0x9E3779B1)
        gram >>= np.uint32(32 - BITS)
        counts = np.maximum(np.diff(offsets) - n + 1, 0)
        # n-grams that begin in a text but end in the next one are left out
        own = np.repeat(np.arange(len(counts)), counts)
        first = np.repeat(offsets[:-1], counts) + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        flat[own * (1 << BITS) + gram[first]] = 1
    return rows


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    low = LOWER[data]
    plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~found & (wide[offsets[1:]] > wide[offsets[:-1]])):
        found[k] = any(c.isalpha() for c in column[int(k)].as_py())
    return found


class Model:
    def __init__(self, labels: list[str], rows: np.ndarray):
        """Fits on presence rows; the first rows of each label are its landmarks."""
        names = np.array(labels)
        self.names = sorted(set(labels))
        marks = np.concatenate([np.flatnonzero(names == name)[:LANDMARKS_PER_LANGUAGE] for name in self.names])
        self.landmarks = np.ascontiguousarray(self._unit(rows[marks]).T)
        values, vectors = np.linalg.eigh((self.landmarks.T @ self.landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # kernel values to Nyström features
        seen = self._kernel(rows).astype(np.float64) @ root
        wanted = (names[:, None] == np.array(self.names)[None, :]).astype(np.float64)
        share = np.sqrt(1 / wanted.sum(axis=0))[wanted.argmax(axis=1)][:, None]  # every language weighs the same
        left = (seen * share).T @ (seen * share) + RIDGE * np.eye(seen.shape[1])
        self.weights = (root @ np.linalg.solve(left, (seen * share).T @ (wanted * share))).astype(np.float32)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))

    def _kernel(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.landmarks) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self._kernel(rows) @ self.weights


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, most: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """At most ``most`` labelled rows per language, those of the smallest hashes of id and text, outside the held-out fold."""
    open_rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    own = F.xxhash64("doc_id", "text")
    counts = open_rows.groupBy("lang").agg(F.approx_count_distinct(own).alias("n")).collect()  # the labels of the model, one row each
    if not counts:
        return open_rows.selectExpr("lang", "text", "0 as place")
    dice = F.pmod(own, F.lit(1 << 40)) / float(1 << 40)
    # A first cut by the hash leaves about twice the different rows wanted, however large a language is; then the exact rank.
    share = F.create_map(*[F.lit(x) for row in counts for x in (row.lang, row.n)])[F.col("lang")]
    near = open_rows.withColumn("_dice", dice).where(F.col("_dice") * share < 2 * most + 100)
    near = near.selectExpr("lang", "text", "row_number() over (partition by lang order by _dice, doc_id, text) as place")
    return near.where(F.col("place") <= most)


def fit(docs: DataFrame) -> Model | None:
    def features(batches):
        for batch in chunks(batches):
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                bits = np.packbits(presence(*text_bytes(part.column("text"))).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array([row.tobytes() for row in bits], type=pa.binary())],
                                                 names=["lang", "place", "bits"])

    # Bounded: so many rows per language, a kilobyte each.
    rows = sorted(training_rows(docs).mapInArrow(features, "lang string, place int, bits binary").collect(), key=lambda r: (r.lang, r.place))
    if not rows:
        return None
    bits = np.frombuffer(b"".join(r.bits for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    return Model([r.lang for r in rows], np.unpackbits(bits, axis=1).astype(np.float32))


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = picked.sparkSession.sparkContext.broadcast(fit(picked))

    def label(batches):
        know = model.value
        for batch in chunks(batches):
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if know is not None:
                    text = part.column("text")
                    scores = know.scores(presence(*text_bytes(text)))
                    best = scores.argmax(axis=1)
                    letters = has_letter(text)
                    names = [know.names[b] if ok else "und" for b, ok in zip(best, letters)]
                    score = np.where(letters, np.clip(scores.max(axis=1), 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    rows = picked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")
