"""Numpy views of Arrow text batches: bytes, words and rolling hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # texts are worked on in runs of about this size; one longer text is a run of its own

PIECE_BYTES = 1 << 19  # hashed at once, within a run

_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[_SPACES] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def chunks(batches, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive rows whose texts add up to about ``most`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        first, base = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(first, last - first)
            first, base = last, int(ends[last - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one more entry for the end).  Null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes, and the number of words before each text (one more for the end)."""
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        run = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        run[0] = 1
        have = _powers[name] = np.cumprod(run, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]``, from one prefix sum; equal runs hash alike wherever they lie."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power("base", _BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; worked out piece by piece, since sums over bytes take eight times the room of the text."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        out[first:last] = run_hashes(byte_codes(data[base: ends[last - 1]]), starts[first:last] - base, ends[first:last] - base)
        first = last
    return out


def owners(counts: np.ndarray) -> np.ndarray:
    """For each item the number of its text, from the running item counts that ``words`` returns."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def cover_runs(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places some run of ``length`` from one of ``starts`` covers."""
    marks = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(marks[:n]) > 0
