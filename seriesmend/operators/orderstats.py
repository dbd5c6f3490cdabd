"""Median and median absolute deviation of moving frames of any width.

A frame of a few dozen values can be sorted row by row; one of thousands cannot.  Here
the values of a block are replaced by dense ranks and those by running counts: on every
bit of the rank, from the highest, a column counts the values before a place whose bit is
zero, and the values are then regrouped by that bit (a wavelet matrix).  The k-th smallest
value of any frame follows from two look-ups per bit, so a row costs the same for every
width, and the memory of a row is one count per bit, never a frame.

The repeated first and last difference beyond the ends of a series are weights in the
counts; they are not written out.
"""

from __future__ import annotations

import numpy as np

AT_ONCE = 65_536   # frames looked up together


class RunningCounts:
    """Zero bits before every place, one column per bit of the rank."""

    def __init__(self, ranks: np.ndarray, distinct: int):
        self.bits = max(int(distinct - 1).bit_length(), 1)
        self.before: list[np.ndarray] = []
        order = ranks
        for bit in reversed(range(self.bits)):
            one = (order >> bit & 1).astype(bool)
            counts = np.zeros(len(order) + 1, np.int32 if len(order) < 1 << 31 else np.int64)
            np.cumsum(~one, out=counts[1:])
            self.before.append(counts)
            order = np.concatenate([order[~one], order[one]])

    def kth(self, start: np.ndarray, end: np.ndarray, k: np.ndarray, weights=()) -> np.ndarray:
        """Rank of the k-th (from 0) smallest value of each frame [start, end).

        ``weights`` are (rank, copies per frame): values a frame holds besides.
        """
        rank = np.zeros(len(k), np.int64)
        extra = [(r, n) for r, n in weights]
        for bit, before in zip(reversed(range(self.bits)), self.before):
            zeros_start, zeros_end = before[start], before[end]
            zeros = (zeros_end - zeros_start).astype(np.int64)
            for r, n in extra:
                if not r >> bit & 1:
                    zeros = zeros + n
            up = k >= zeros
            k = k - np.where(up, zeros, 0)
            all_zeros = before[-1]
            start = np.where(up, all_zeros + start - zeros_start, zeros_start)
            end = np.where(up, all_zeros + end - zeros_end, zeros_end)
            extra = [(r, np.where(up == bool(r >> bit & 1), n, 0)) for r, n in extra]
            rank |= up.astype(np.int64) << bit
        return rank


def moving_median_mad(steps: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median and MAD of the frames of ``2 * half + 1`` steps around each step, and whether
    the frame holds any value.

    Missing steps (NaN) are left out; beyond the ends the first and last step repeat.
    A MAD is of the distances that are defined, NaN if none is.
    """
    n = len(steps)
    median, mad, known = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
    sound = ~np.isnan(steps)
    values, ranks = np.unique(steps[sound], return_inverse=True)
    if not len(values):
        return median, mad, known
    counts = RunningCounts(ranks.reshape(-1), len(values))
    place = np.concatenate([[0], np.cumsum(sound)])     # of a step among the sound ones
    edges = [int(np.searchsorted(values, steps[i])) if sound[i] else None for i in (0, -1)]
    for at in range(0, n, AT_ONCE):
        here = np.arange(at, min(at + AT_ONCE, n))
        start, end = place[np.maximum(here - half, 0)], place[np.minimum(here + half + 1, n)]
        outside = (np.maximum(half - here, 0), np.maximum(here + half - (n - 1), 0))
        weights = [(edge, many) for edge, many in zip(edges, outside) if edge is not None and many.any()]
        size = end - start + sum(many for _, many in weights)
        known[here] = filled = size > 0
        frames = _Frames(counts, values, start[filled], end[filled], [(r, m[filled]) for r, m in weights], size[filled])
        median[here[filled]] = centre = frames.median()
        mad[here[filled]] = frames.deviation(centre)
    return median, mad, known


class _Frames:
    def __init__(self, counts: RunningCounts, values, start, end, weights, size):
        self.counts, self.values = counts, values
        self.start, self.end, self.weights, self.size = start, end, weights, size

    def some(self, chosen: np.ndarray) -> "_Frames":
        return _Frames(self.counts, self.values, self.start[chosen], self.end[chosen],
                       [(r, m[chosen]) for r, m in self.weights], self.size[chosen])

    def at(self, k: np.ndarray) -> np.ndarray:
        return self.values[self.counts.kth(self.start, self.end, k, self.weights)]

    def median(self) -> np.ndarray:
        with np.errstate(invalid="ignore"):   # inf - inf
            return (self.at((self.size - 1) // 2) + self.at(self.size // 2)) / 2

    def deviation(self, centre: np.ndarray) -> np.ndarray:
        out = np.full(len(centre), np.nan)
        finite = np.isfinite(centre)
        if finite.any():
            inner = self.some(finite)
            out[finite] = inner._near(centre[finite])
        endless = np.isinf(centre)
        if endless.any():
            # only values other than the centre have a distance to it
            outer = self.some(endless)
            c = centre[endless]
            others = (outer.at(np.zeros_like(outer.size)) != c) | (outer.at(outer.size - 1) != c)
            out[endless] = np.where(others, np.inf, np.nan)
        return out

    def _near(self, centre: np.ndarray) -> np.ndarray:
        """Median distance to a finite centre."""
        k = (self.size + 1) // 2
        nearest = self._kth_distance(centre, k)
        even = self.size % 2 == 0
        if even.any():
            nearest[even] = (nearest[even] + self.some(even)._kth_distance(centre[even], k[even] + 1)) / 2
        return nearest

    def _kth_distance(self, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k nearest values are neighbours in order: the stretch of k values whose
        farther end is least far.  From left to right its left end comes nearer and its
        right end goes away, so where they cross is found by halving."""
        low, high = np.zeros_like(self.size), self.size - k   # the first stretch with right >= left
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) // 2
            crossed = centre - self.at(middle) <= self.at(middle + k - 1) - centre
            high = np.where(open_ & crossed, middle, high)
            low = np.where(open_ & ~crossed, middle + 1, low)
        far = lambda i: np.maximum(centre - self.at(i), self.at(i + k - 1) - centre)
        return np.minimum(far(low), far(np.maximum(low - 1, 0)))
