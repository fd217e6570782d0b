"""A batch of suffixes in order, by a mergesort whose comparisons go over prefix polynomial hashes."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

#: Odd, so that powers never vanish modulo 2^64; and a value for each byte.
BASE = np.uint64(0x1F3D5B79A2C4E68B)
VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 23) for b in range(256)], np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Suffixes:
    """Contexts, each with an anchor in it; suffixes start at the anchors.

    Contexts are held aligned at their anchors, `left` bytes before and `right` after. Of each, sums[k] is the polynomial hash of
    the first k bytes on from the anchor, and back[k] that of the last k before it.
    """

    def __init__(self, contexts: list[bytes], anchors: np.ndarray, left: int, right: int) -> None:
        self.left, self.right = left, right
        lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.before, self.after = anchors.astype(np.int64), lengths - anchors
        row = np.repeat(np.arange(len(contexts)), lengths)
        column = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - left + anchors, lengths)
        self.raw = np.zeros((len(contexts), left + right), np.uint8)
        self.raw[row, column] = np.frombuffer(b"".join(contexts), np.uint8)
        self.sums = self.hashes(self.raw[:, left:])
        self.back = self.hashes(self.raw[:, :left][:, ::-1])

    @staticmethod
    def hashes(raw: np.ndarray) -> np.ndarray:
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(raw.shape[1] - 1, 0), BASE)]))
        out = np.zeros((len(raw), raw.shape[1] + 1), np.uint64)
        np.cumsum(VALUES[raw] * power[: raw.shape[1]], axis=1, out=out[:, 1:])
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that suffixes i and j have in common, pair by pair: binary search for the longest prefixes with equal hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.after[i], self.after[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.sums[i, mid] == self.sums[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Below, at or above 0 as suffix i comes before j, equals it, or comes after it."""
        n = self.ahead(i, j)
        last = self.left + self.right - 1
        x = np.where(n < self.after[i], self.raw[i, np.minimum(self.left + n, last)].astype(np.int16), -1)
        y = np.where(n < self.after[j], self.raw[j, np.minimum(self.left + n, last)].astype(np.int16), -1)
        return np.sign(x - y)

    def order(self, group: np.ndarray) -> np.ndarray:
        """The rows, those of a group (which are adjacent) sorted by their suffixes.

        Sorted runs of 1, 2, 4 and so on are merged, all of a width at once: each suffix finds its place in the other run by binary search.
        """
        n = len(group)
        change = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        sizes = np.diff(change)
        first, end = np.repeat(change[:-1], sizes), np.repeat(change[1:], sizes)
        order, width, place = np.arange(n), 1, np.arange(n)
        while width < sizes.max(initial=0):
            start = first + (place - first) // (2 * width) * (2 * width)
            middle, stop = np.minimum(start + width, end), np.minimum(start + 2 * width, end)
            p = np.flatnonzero(middle < stop)
            start, middle, stop = start[p], middle[p], stop[p]
            ours = p < middle
            base = np.where(ours, middle, start)
            low, high = base.copy(), np.where(ours, stop, middle)
            while len(q := np.flatnonzero(low < high)):
                at = (low[q] + high[q]) // 2
                sign = self.compare(order[at], order[p[q]])
                before = (sign < 0) | ((sign == 0) & ~ours[q])
                low[q], high[q] = np.where(before, at + 1, low[q]), np.where(before, high[q], at)
            to = np.where(ours, p, start + p - middle) + low - base
            merged = order.copy()
            merged[to] = order[p]
            order, width = merged, 2 * width
        return order

    def repeats(self, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the first and last place of its `length`-byte strings, from its anchor, that another row of its group has at the same place.

        Rows without one have a first place of 1. Strings hold the anchor or start there, so places are from -left to 0. Two
        rows share the string at -k if length - k bytes on from their anchors agree, so that no step between
        them in the order is shorter, and k bytes before. What hashes say is verified by bytes.
        """
        order = self.order(group)
        n = len(order)
        steps = np.where(group[order[1:]] == group[order[:-1]], self.ahead(order[1:], order[:-1]), -1)
        before, after = self.before[order], self.after[order]
        first, last = np.ones(n, np.int64), np.full(n, -self.left - 1)
        first_with, last_with = np.arange(n), np.arange(n)
        for k in range(self.left, -1, -1):
            run = np.concatenate([[0], np.cumsum(steps < length - k)]).astype(np.uint64)
            at = np.flatnonzero((before >= k) & (after >= length - k))
            key = (self.back[order[at], k] ^ (run[at] * SPREAD)) * BASE + run[at]
            sort = np.argsort(key, kind="stable")
            key, rows = key[sort], order[at[sort]]
            same = key[1:] == key[:-1]
            a, b = rows[:-1][same], rows[1:][same]
            for x, y in ((a, b), (b, a)):
                new = first[x] == 1
                first[x[new]], first_with[x[new]] = -k, y[new]
                last[x], last_with[x] = -k, y
        found = np.flatnonzero(first < 1)
        wrong = found[~(self.equal(found, first_with[found], first[found], length) & self.equal(found, last_with[found], last[found], length))]
        for g in np.unique(group[wrong]):  # hashes that collided: strings themselves
            self.by_bytes(np.flatnonzero(group == g), length, first, last)
        return first, last

    def equal(self, i: np.ndarray, j: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
        columns = self.left + place[:, None] + np.arange(length)
        return (i != j) & (self.raw[i[:, None], columns] == self.raw[j[:, None], columns]).all(axis=1)

    def by_bytes(self, rows: np.ndarray, length: int, first: np.ndarray, last: np.ndarray) -> None:
        first[rows], last[rows] = 1, -self.left - 1
        for k in range(self.left, -1, -1):
            there = defaultdict(list)
            for x in rows[(self.before[rows] >= k) & (self.after[rows] >= length - k)].tolist():
                there[self.raw[x, self.left - k : self.left - k + length].tobytes()].append(x)
            for same in there.values():
                for x in same if len(same) > 1 else ():
                    first[x], last[x] = (-k if first[x] == 1 else first[x]), -k
