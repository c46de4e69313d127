"""Keys of the perfect binary Golay code [23, 12, 7] for fuzzy hashing of 64-bit fingerprints.

Every 23-bit word lies within 3 bits of exactly one codeword. Its keys K are
the indices of the codewords within 4 bits: that one and, if it is 3 bits
away, the five at distance 4. Words that differ in at most 2 bits share a key:
both are within 1 bit of some word between them, so within 4 of its codeword.
Words that differ in at most 1 bit even have the nearest codeword of the one
among the keys of the other.

A fingerprint has three segments of 23, 23 and 18 bits (the last padded with
zeros). Of at most 4 differing bits, the two segments with the fewest have at
most 2 together, split (0, up to 2) or (1, 1). For each pair of segments S, T
a fingerprint gets the keys (nearest of S, K of T) and (K of S, nearest of T);
two fingerprints within 4 bits share one of these for some pair:
(0, 2) by an equal nearest codeword in S and a common key in T, (1, 1) by
(nearest of x in S, nearest of y in T).
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; per syndrome the nearest error, and the five of weight 4 (or zeros)."""
    low = np.array([_syndrome(x) for x in range(4096)], np.int64)
    high = np.array([_syndrome(x << 12) for x in range(2048)], np.int64)
    single = [_syndrome(1 << b) for b in range(23)]
    near, far = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            error = sum(1 << b for b in bits)
            if weight < 4:
                near[s] = error
            else:
                far[s].append(error)
    return low, high, near, np.array([(x + [0] * 5)[:5] for x in far], np.int64)


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 23-bit words: the index of the nearest codeword, all six keys, and which of the six hold."""
    low, high, near, far = tables()
    s = low[words & 4095] ^ high[words >> 12]
    nearest = (words ^ near[s]) >> 11
    keys = np.empty((len(words), 6), np.int64)
    keys[:, 0] = nearest
    keys[:, 1:] = (words[:, None] ^ far[s]) >> 11
    holds = np.ones((len(words), 6), bool)
    holds[:, 1:] = far[s] != 0
    return nearest, keys, holds


def pair_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of 64-bit fingerprints; keys of different segment pairs differ."""
    x = fingerprints.astype(np.uint64)
    parts = [segment_keys(((x >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    rows, keys = [], []
    for p, (a, b) in enumerate(combinations(range(3), 2)):
        (near_a, keys_a, holds_a), (near_b, keys_b, holds_b) = parts[a], parts[b]
        r, c = np.nonzero(holds_b)
        rows.append(r)
        keys.append(p << 24 | near_a[r] << 12 | keys_b[r, c])
        holds_a = holds_a.copy()
        holds_a[:, 0] = False  # (nearest, nearest) is there already
        r, c = np.nonzero(holds_a)
        rows.append(r)
        keys.append(p << 24 | keys_a[r, c] << 12 | near_b[r])
    return np.concatenate(rows), np.concatenate(keys)
