"""Words and word shingles of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

#: Words are runs of letters, digits and underscores, in lower case.
WORD = re.compile(r"\w+")
SHINGLE = 5
FACTOR = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class WordHashes(dict):
    """Hash of a word, kept until the table is full."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(tokens: list[str], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; a shorter text is one run of all its words."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(FACTOR) + h[i : i + n]
    return mixed(out)


def shingle_set(text: str | None, table: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; none if it has no word."""
    return np.unique(rolled(hashed(words(text), table), k))
