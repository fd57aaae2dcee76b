"""Arrow batch kernels: dense vector products inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column, unit: bool = True) -> np.ndarray:
    """List column -> (rows, dim) float64 matrix, rows scaled to unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)
    if unit:
        m = m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)
    return m


def top_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, position) of the ``k`` best columns per row, lowest column first on ties."""
    n, m = scores.shape
    k = min(k, m)
    if n == 0 or k == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(n))
    position = np.arange(len(rows)) - first[rows]
    keep = (position < k) & np.isfinite(scores[rows, cols])
    return rows[keep], cols[keep], position[keep]


ROUGH_COLUMNS = 2048  # right rows of one rough product, which then stays in a core's cache


def rough(m: np.ndarray) -> np.ndarray:
    """The matrix in single precision, for products that only say what needs the exact one; vectors that are no numbers count as zero."""
    return np.nan_to_num(m.astype(np.float32))


def rough_slack(dim: int) -> float:
    """No product of two unit vectors in single precision is further than this from the exact one (twice the bound on its rounding)."""
    return (dim + 8) * 2.0 ** -23


def spanning_forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row/column index pairs of a spanning forest of the bipartite graph ``close``.

    At most rows + columns - 1 pairs, however many entries are set.
    """
    n, m = close.shape
    row_seen, col_seen = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
    out_rows, out_cols = [], []
    for seed in range(n):
        if row_seen[seed]:
            continue
        row_seen[seed] = True
        frontier = np.array([seed])
        while len(frontier):
            block = close[frontier]
            cols = np.nonzero(block.any(axis=0) & ~col_seen)[0]
            if not len(cols):
                break
            col_seen[cols] = True
            out_rows.append(frontier[block[:, cols].argmax(axis=0)])
            out_cols.append(cols)
            reach = close[:, cols]
            rows = np.nonzero(reach.any(axis=1) & ~row_seen)[0]
            row_seen[rows] = True
            out_rows.append(rows)
            out_cols.append(cols[reach[rows].argmax(axis=1)])
            frontier = rows
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_rows) if out_rows else none), (np.concatenate(out_cols) if out_cols else none)
