"""Hashes of words and of word shingles, with numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from xxhash import xxh3_64_intdigest

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit of the input changes half of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: Sequence[str | bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, in order; of fewer words, one hash of them all; of none, none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = words[: n - k + 1].copy()
    for j in range(1, k):
        h = h * _ODD + words[j : n - k + 1 + j]
    return mixed(h + np.uint64(k))
