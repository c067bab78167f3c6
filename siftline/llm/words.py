"""Words and word hashes shared by the text operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


class WordIds(dict):
    """64-bit hashes of words, remembered; forgotten when too many are held."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive word hashes, one per position (none if there are fewer words)."""
    if len(ids) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + ids[i : len(ids) - n + 1 + i])
    return out
