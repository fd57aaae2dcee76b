"""Cutting stock by column generation: which patterns of lengths fill sequences of one capacity with the least waste.

The linear program has a row per class of lengths, a few hundred of them however much data the histogram counts, so it is solved
where the plan is made.  Its columns are patterns; a knapsack by dynamic programming over capacities prices them against the
duals.  ``layout`` turns the rounded patterns into intervals of ranks: which piece of a length goes where, in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAP = 0.002
PRICES = 150  # knapsacks solved at most; what the patterns still waste then is filled from the stream
EXACT = 32  # lengths up to here are classes of their own; above, a class spans a 32nd of its length


def classes(lengths: np.ndarray) -> list[np.ndarray]:
    """The lengths that occur, ascending, in runs that one row of the program stands for (by the longest of the run)."""
    if len(lengths) <= 256:
        return [lengths[k: k + 1] for k in range(len(lengths))]
    octave = np.maximum(0, np.floor(np.log2(np.maximum(lengths, 1) / EXACT))).astype(np.int64)
    grid = octave * (1 << 40) + lengths // np.maximum(1, 1 << octave)
    return np.split(lengths, np.flatnonzero(np.diff(grid)) + 1)


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value per capacity, and the length that goes in last (0: none); ``values[l - 1]`` is what a length is worth, or minus infinity."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        most = min(room, len(values))
        worth = best[room - most: room][::-1] + values[:most]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], last[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, last


def _taken(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        out += [int(last[room])] if last[room] else []
        room -= max(1, int(last[room]))
    return out


def patterns(lengths: np.ndarray, need: np.ndarray, capacity: int, columns_a_price: int = 20) -> list[tuple[np.ndarray, int]]:
    """(copies of each length, uses): together they use no more of any length than there is; what stays over is less than a use of each.

    Starts from one pattern per length and pivots priced columns in until the program is within ``GAP`` of its optimum; the uses
    are then rounded down.  Duals swing widely at first, so columns are priced at a point between them and the best duals yet (at first
    each length's share of the capacity), nearer to the duals whenever that finds no column.
    """
    m = len(lengths)
    fit = capacity // lengths
    basis, inverse, amount = np.diag(fit.astype(float)), np.diag(1.0 / fit), need / fit
    row_of = {int(k): i for i, k in enumerate(lengths)}
    centre, bound, pull = lengths / capacity, 0.0, 0.9
    for _ in range(PRICES):
        duals = pull * centre + (1 - pull) * inverse.sum(axis=0)
        worth = np.full(int(lengths[-1]), -np.inf)
        worth[lengths - 1] = duals
        best, last = knapsack(worth, capacity)
        reached = float(need @ duals) / max(1.0, best[capacity])  # no program can do with fewer sequences
        if reached > bound:
            bound, centre = reached, duals
        if amount.sum() <= (1 + GAP) * bound or pull < 0.01:
            break
        through = duals + best[capacity - lengths]  # the best pattern that holds each length
        entered = 0
        for i in np.argsort(-through)[:columns_a_price]:
            column = np.bincount([row_of[k] for k in [int(lengths[i]), *_taken(last, capacity - int(lengths[i]))]], minlength=m).astype(float)
            if inverse.sum(axis=0) @ column <= 1 + 1e-7:
                continue  # no gain, or the columns before it have moved the duals
            moved = inverse @ column
            up = np.flatnonzero(moved > 1e-9)
            ratio = amount[up] / moved[up]
            out, step = int(up[ratio.argmin()]), float(ratio.min())
            pivot = inverse[out] / moved[out]
            inverse -= np.outer(moved, pivot)
            inverse[out] = pivot
            amount = np.clip(amount - step * moved, 0.0, None)
            amount[out] = step
            basis[:, out] = column
            entered += 1
        pull = pull if entered else pull / 2
    uses, whole = np.floor(amount + 1e-9).astype(np.int64), basis.astype(np.int64)
    for i in range(m):  # rounding errors of the solver, if any
        while whole[i] @ uses > need[i]:
            uses[np.flatnonzero((whole[i] > 0) & (uses > 0))[0]] -= 1
    return [(whole[:, j], int(uses[j])) for j in np.flatnonzero(uses)]


@dataclass(frozen=True)
class Layout:
    """Where pieces go.  Pieces of ``length`` with rank ``lo`` and up: ``copies`` to a sequence from ``sequence`` on, the first at ``offset``.

    Where ``copies`` is 0 the pieces lie end to end on a stream, from ``offset`` on; the stream is cut into sequences by its regions:
    from ``at`` on, ``unit`` tokens each go to the sequences from ``into`` on, at ``inside``.
    """

    length: np.ndarray
    lo: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    at: np.ndarray
    unit: np.ndarray
    into: np.ndarray
    inside: np.ndarray


def _segments(runs: list[tuple[np.ndarray, np.ndarray]], found: list[tuple[np.ndarray, int]], capacity: int) -> list[dict]:
    """Class patterns as exact ones: the longest pieces of a class are used first, and a pattern is split where their length changes."""
    used, out = [0] * len(runs), []
    for copies, uses in found:
        own = [(c, int(copies[c]), used[c]) for c in np.flatnonzero(copies)]
        stops = {0, uses}
        for c, a, start in own:
            edges = runs[c][1]
            for edge in edges[(edges > start) & (edges < start + a * uses)] - start:
                stops |= {int(edge) // a, -(-int(edge) // a)}
            used[c] += a * uses
        for first, last in zip(sorted(stops)[:-1], sorted(stops)[1:]):
            rows, filled = [], 0
            for c, a, start in own:
                lengths, edges = runs[c]
                rank, end = start + first * a, start + last * a
                while rank < end:
                    k = int(np.searchsorted(edges, rank, side="right")) - 1
                    stop = min(end, int(edges[k + 1]))
                    each = a if stop - rank == a * (last - first) else stop - rank
                    rows.append((int(lengths[k]), rank - int(edges[k]), each, filled))
                    filled += each * int(lengths[k])
                    rank = stop
            out.append({"uses": last - first, "rows": rows, "filled": filled, "waste": capacity - filled})
    return out


def layout(counts: dict[int, int], capacity: int, first_sequence: int = 0) -> Layout:
    """The places of ``counts[length]`` pieces of each length (1 to capacity).

    Sequences of patterns are topped up from the stream, so only as many patterns are used as all tokens can fill; what the stream has
    left makes full sequences, and its end sequences of a power of two each.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n), dtype=np.int64)
    runs, segments = [], []
    if len(lengths):
        runs = [(run[::-1], np.concatenate([[0], np.cumsum([counts[int(k)] for k in run[::-1]])])) for run in classes(lengths)]
        segments = _segments(runs, patterns(np.array([r[0][0] for r in runs]), np.array([float(r[1][-1]) for r in runs]), capacity), capacity)
    total = sum(int(k) * counts[int(k)] for k in lengths)
    over = sum(s["uses"] for s in segments) - total // capacity
    for s in sorted(segments, key=lambda s: -s["waste"]):
        gone = min(max(over, 0), s["uses"])
        s["uses"], over = s["uses"] - gone, over - gone
    rows, regions, sequence, stream = [], [], first_sequence, 0
    for s in segments:
        if s["uses"]:
            rows += [(length, lo, each, sequence, offset, each * s["uses"]) for length, lo, each, offset in s["rows"]]
            if s["waste"]:
                regions.append((stream, s["waste"], sequence, s["filled"]))
                stream += s["waste"] * s["uses"]
            sequence += s["uses"]
    rows.sort()
    placed, tail, at = [], 0, 0
    for length in lengths:
        rank = 0
        while at < len(rows) and rows[at][0] == length or rank < counts[int(length)]:
            more = at < len(rows) and rows[at][0] == length
            lo = rows[at][1] if more else counts[int(length)]
            if rank < lo:
                placed.append((int(length), rank, 0, 0, tail))
                tail += (lo - rank) * int(length)
            if more:
                placed.append(rows[at][:5])
                rank, at = lo + rows[at][5], at + 1
            else:
                rank = lo
    left = tail - stream
    if left >= capacity:
        regions.append((stream, capacity, sequence, 0))
        sequence, stream = sequence + left // capacity, stream + left // capacity * capacity
    for bit in reversed(range(int(left % capacity).bit_length())):
        if (left % capacity) >> bit & 1:
            regions.append((stream, 1 << bit, sequence, 0))
            sequence, stream = sequence + 1, stream + (1 << bit)
    columns = [np.array(c, dtype=np.int64) for c in zip(*placed)] or [np.empty(0, np.int64)] * 5
    cuts = [np.array(c, dtype=np.int64) for c in zip(*regions)] or [np.empty(0, np.int64)] * 4
    return Layout(*columns, *cuts)


def places(plan: Layout, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence (-1: on the stream) and offset, or place on the stream, of each piece."""
    wide = 1 << 48
    row = np.searchsorted(plan.length * wide + plan.lo, lengths * wide + ranks, side="right") - 1
    copies, k = plan.copies[row], ranks - plan.lo[row]
    in_pattern = copies > 0
    sequence = np.where(in_pattern, plan.sequence[row] + k // np.maximum(copies, 1), -1)
    offset = plan.offset[row] + np.where(in_pattern, k % np.maximum(copies, 1), k) * lengths
    return sequence, offset, row


def stretches(plan: Layout, place: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of the parts of a piece that lies on the stream."""
    out, done = [], 0
    while done < length:
        k = int(np.searchsorted(plan.at, place + done, side="right")) - 1
        beyond, unit = place + done - int(plan.at[k]), int(plan.unit[k])
        take = min(length - done, unit - beyond % unit)
        out.append((done, take, int(plan.into[k]) + beyond // unit, int(plan.inside[k]) + beyond % unit))
        done += take
    return out
