"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Both are linear in the text.  Passes over the array run bucket by bucket; all suffixes of a bucket that are known at a time are
taken together, so the number of steps follows the alphabet and the longest run of one letter, not the length of the text.
"""

from __future__ import annotations

import numpy as np

from callweave.llm.batches import run_hashes

WIDEST = 1024  # letters up to which bucket passes pay; reduced strings over more names are sorted by doubling


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last, a sentinel, counts as S."""
    step = np.sign(np.diff(text.astype(np.int64)))
    n = len(text)
    at = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    small = np.ones(n, dtype=bool)
    known = after < n
    small[:-1][known] = step[after[known]] > 0
    return small


class _Buckets:
    def __init__(self, text: np.ndarray, letters: int):
        self.text, self.letters = text, letters
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
        self.used = np.flatnonzero(np.diff(self.begin))

    def _place(self, order: np.ndarray, edge: np.ndarray, suffixes: np.ndarray, step: int) -> None:
        letter = self.text[suffixes]
        rank = np.argsort(letter, kind="stable")
        letter = letter[rank]
        count = np.bincount(letter, minlength=self.letters)
        within = np.arange(len(letter)) - (np.cumsum(count) - count)[letter]
        order[edge[letter] + step * within] = suffixes[rank]
        edge += step * count

    def induce(self, seeds: np.ndarray, small: np.ndarray) -> np.ndarray:
        """The array induced from leftmost-smaller suffixes given in order: larger ones from the left, then smaller ones from the right."""
        n = len(self.text)
        order = np.full(n, -1, dtype=np.int64)
        tail = self.begin[1:] - 1
        seeded = tail.copy()
        self._place(order, seeded, seeds[::-1], -1)
        head = self.begin[:-1].copy()

        def larger(block: np.ndarray) -> None:
            left = block - 1
            left = left[(left >= 0)]
            left = left[~small[left]]
            if len(left):
                self._place(order, head, left, 1)

        for c in self.used:
            done = self.begin[c]
            while done < head[c]:
                block, done = order[done: head[c]].copy(), head[c]
                larger(block)
            larger(order[seeded[c] + 1: self.begin[c + 1]].copy())
        tail = self.begin[1:] - 1

        def smaller(block: np.ndarray) -> None:
            left = block - 1
            left = left[(left >= 0)]
            left = left[small[left]]
            if len(left):
                self._place(order, tail, left, -1)

        first = tail.copy()
        tail[0] -= 1  # the sentinel keeps its place
        order[0] = n - 1
        for c in self.used[::-1]:
            done = first[c]
            if c == 0:
                done = tail[0]
                smaller(order[:1].copy())
            while done > tail[c]:
                block, done = order[tail[c] + 1: done + 1][::-1].copy(), tail[c]
                smaller(block)
            smaller(order[self.begin[c]: head[c]][::-1].copy())
        return order


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, the last of which is unique: ranks of pairs, then of pairs of pairs, until all differ."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (rank.max() + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of ``text`` (letters 0..letters-1), whose last letter is a 0 that occurs once."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _Buckets(text, letters).induce(lms, small)
    buckets = _Buckets(text, letters)
    # Sort the substrings from one leftmost-smaller suffix to the next, then name them.
    rough = buckets.induce(lms, small)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ranked = rough[is_lms[rough]]
    number = np.empty(n, dtype=np.int64)
    number[lms] = np.arange(len(lms))
    ends = np.minimum(np.append(lms[1:], n - 1) + 1, n)
    print_ = run_hashes(text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1), lms, ends)[number[ranked]]
    names = np.empty(len(lms), dtype=np.int64)
    names[number[ranked]] = np.concatenate([[0], np.cumsum(print_[1:] != print_[:-1])])
    kinds = int(names.max()) + 1
    if kinds == len(lms):
        order = np.argsort(names, kind="stable")
    elif kinds <= WIDEST:
        order = suffix_array(names, kinds)
    else:
        order = _by_doubling(names)
    return buckets.induce(lms[order], small)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): per position its common prefix with the suffix before it in the array, and that suffix (-1 for the first).

    Where the letters before the two suffixes agree, the value is one less than that of the position before; only the other,
    irreducible, values are compared letter by letter.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    before = np.arange(n) - 1
    reducible = (phi > 0) & (before >= 0)
    reducible[reducible] = text[before[reducible]] == text[phi[reducible] - 1]
    reducible &= np.concatenate([[False], phi[1:] == np.where(phi[:-1] >= 0, phi[:-1] + 1, -2)])
    base = np.flatnonzero(~reducible)
    length = np.zeros(n, dtype=np.int64)
    live = base[phi[base] >= 0]
    wide = np.concatenate([text, np.zeros(8, dtype=text.dtype)])
    depth = 0
    while len(live):
        a, b = live + depth, phi[live] + depth
        ok = (a < n) & (b < n)
        same = ok.copy()
        same[ok] = wide[a[ok]] == wide[b[ok]]
        length[live[~same]] = depth
        live = live[same]
        depth += 1
    at = np.maximum.accumulate(np.where(reducible, -1, np.arange(n)))
    return length[at] - (np.arange(n) - at), phi
