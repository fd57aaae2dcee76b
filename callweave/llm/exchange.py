"""Packed exchange: many small records travel as a few binary rows, one per run of texts and partition.

A mapper packs its records by target partition; ``routed`` sends each packed row to the partition it names, and the receiving
side unpacks plain arrays.  Records of one key always meet in one partition, so senders sum up or settle repeats of a key
before they send (see the callers): what a single key can send is bounded by the number of runs, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "part int, packed binary"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def target(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (part, packed): all records of one target partition, column after column."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, dtype=np.int64)
    edges = np.append(first, len(part))
    columns = [c[order] for c in columns]
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[first], type=pa.int32()), pa.array(blobs, type=pa.binary())], names=["part", "packed"])


def unpacked(blobs: Iterable[bytes], kinds: list) -> list[np.ndarray]:
    """The records of several packed rows, as one array per column."""
    kinds = [np.dtype(k) for k in kinds]
    width = sum(k.itemsize for k in kinds)
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for column, kind in zip(found, kinds):
            column.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += n * kind.itemsize
    return [np.concatenate(c) if c else np.empty(0, dtype=k) for c, k in zip(found, kinds)]


def routed(rows: DataFrame) -> DataFrame:
    return rows.repartitionById(partitions(rows), F.col("part"))


def blobs_of(batches: Iterator[pa.RecordBatch], column: str = "packed") -> Iterator[bytes]:
    for batch in batches:
        yield from batch.column(column).to_pylist()


def per_key(keys: np.ndarray, values: np.ndarray, key: str, value: str) -> pa.RecordBatch:
    """Rows (key, packed values), one per distinct key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    edges = np.append(first, len(keys))
    blobs = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(blobs, type=pa.binary())], names=[key, value])
