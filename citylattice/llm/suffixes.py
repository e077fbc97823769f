"""Hash-compared suffix sort of one buffer: the method named for repeated passages, in its plain form.

Two suffixes are compared by their common extension, which binary search over prefix polynomial hashes finds in a
logarithmic number of probes; a second hash verifies it. Suffixes are sorted by merging runs, all pairs of runs of a round
at once. ``repeats`` does not use this on a corpus, for the reason and with the figures given in the README; its results
are tested against it.
"""

from __future__ import annotations

import numpy as np

from citylattice.llm import kernels as K


class Suffixes:
    def __init__(self, data: np.ndarray, stop: np.ndarray, most: int):
        """``stop``: where the text of each byte ends; no extension goes beyond ``most`` bytes or the text."""
        self.data, self.stop, self.most = data, stop, most
        self.first, self.second = K.FIRST.prefix(data), K.SECOND.prefix(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at i and j."""
        high = np.minimum(self.most, np.minimum(self.stop[i] - i, self.stop[j] - j))
        low = np.zeros(len(i), np.int64)
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            same = K.FIRST.spans(self.first, i, i + half) == K.FIRST.spans(self.first, j, j + half)
            same &= K.SECOND.spans(self.second, i, i + half) == K.SECOND.spans(self.second, j, j + half)
            low, high = np.where(same & open_, half, low), np.where(same | ~open_, high, half - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i stands before suffix j; equal beginnings stand by place."""
        n = self.common(i, j)
        a, b = i + n, j + n
        over_a, over_b = (a >= self.stop[i]) | (n >= self.most), (b >= self.stop[j]) | (n >= self.most)
        x = np.where(over_a, -1, self.data[np.minimum(a, len(self.data) - 1)].astype(np.int64))
        y = np.where(over_b, -1, self.data[np.minimum(b, len(self.data) - 1)].astype(np.int64))
        return np.where(x == y, i < j, x < y)

    def order(self, places: np.ndarray) -> np.ndarray:
        """``places`` sorted by their suffixes: merge sort from runs of one."""
        now, n, run = places.copy(), len(places), 1
        while run < n:
            at = np.arange(n)
            mine, inner = at // run, at % run
            other = (mine ^ 1) * run  # the run it is merged with
            size = np.clip(n - other, 0, run)
            low, high = np.zeros(n, np.int64), size.copy()
            while (open_ := low < high).any():
                half = (low + high) // 2
                probe = now[np.minimum(other + half, n - 1)]
                smaller = np.zeros(n, dtype=bool)
                w = np.flatnonzero(open_)
                smaller[w] = self.before(probe[w], now[w])
                low, high = np.where(smaller, half + 1, low), np.where(smaller | ~open_, high, half)
            out = np.empty_like(now)
            out[mine // 2 * 2 * run + inner + low] = now
            now, run = out, run * 2
        return now


def covered(data: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Whether each byte lies in a string of ``length`` bytes that also starts elsewhere, within one buffer of texts."""
    stop = np.repeat(offs[1:], np.diff(offs))
    at = np.flatnonzero(np.arange(len(data)) + length <= stop)
    edge = np.zeros(len(data) + 1, np.int64)
    if len(at) > 1:
        s = Suffixes(data, stop, length)
        sorted_ = s.order(at)
        same = s.common(sorted_[:-1], sorted_[1:]) >= length
        twice = np.unique(np.concatenate([sorted_[:-1][same], sorted_[1:][same]]))
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + length, -1)
    return np.cumsum(edge[:-1]) > 0
