"""FM-index over a sequence of small integers, with queries answered for arrays at once.

Occurrence counts come from a wavelet matrix over the Burrows-Wheeler
transform; positions from every SAMPLE-th suffix position, reached by walking
backwards from an occurrence.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s by prefix doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Of s, whose symbols are positive; 0 ends it."""

    def __init__(self, s: np.ndarray):
        text = np.concatenate([s, [0]]).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.top = len(text), int(text.max())
        counts = np.bincount(text, minlength=self.top + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        level = bwt
        for bit in range(max(1, self.top.bit_length()) - 1, -1, -1):
            ones = (level >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(len(level) - ones.sum())))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        self.first = self._down(np.arange(self.top + 1), np.zeros(self.top + 1, np.int64))
        self.bwt = bwt
        self.sampled = order % SAMPLE == 0
        self.at = np.where(self.sampled, order, 0)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            up = ones[i]
            i = np.where((c >> bit) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands among the first i symbols of the transform."""
        return self._down(c, i) - self.first[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases (rows of equal length), matched from their last symbol backwards."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = (phrases <= self.top).all(1) if len(phrases) else np.zeros(0, bool)
        for j in range(phrases.shape[1] - 1, -1, -1):
            k = np.flatnonzero(alive)
            if not len(k):
                break
            c = phrases[k, j]
            lo[k] = self.before[c] + self.rank(c, lo[k])
            hi[k] = self.before[c] + self.rank(c, hi[k])
            alive[k] = lo[k] < hi[k]
        hi[~alive] = lo[~alive]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by their places in the order."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        while len(k := np.flatnonzero(~self.sampled[rows])):
            c = self.bwt[rows[k]]
            rows[k] = self.before[c] + self.rank(c, rows[k])
            steps[k] += 1
        return self.at[rows] + steps
