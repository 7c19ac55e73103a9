"""Words, runs of words and their hashes, shared by the operators that compare texts.

Words are maximal runs of letters and digits, lower-cased. A text's set is that of the 64-bit
hashes of its distinct runs of ``size`` words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MASK = 2**64 - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words by word; emptied when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def words(text: str | None) -> list[str]:
    """The words of ``text``; none for null."""
    return WORD.findall(text.lower()) if text else []


def shingle_set(tokens: list[str], hashes: WordHashes, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; empty for shorter texts."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    run = h[:n] * _ODD[0]
    for k in range(1, size):
        run = mixed(run) + h[k : n + k] * _ODD[k % len(_ODD)]
    return np.unique(mixed(run))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a set; equal sets have equal ids."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes()))))
