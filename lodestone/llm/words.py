"""Words of a text and their 64-bit hashes, shared by several operators.

A word is a maximal run of letters, digits and underscores of the lower-cased
text. A null text has no words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: The same words in RE2 syntax, for SQL.
WORD_RE2 = r"[\p{L}\p{N}_]+"
find_words = re.compile(r"\w+").findall


class WordHashes(dict):
    """word -> signed 64-bit hash; remembers a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        h -= (h >> 63) << 64
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def words(text: str | None) -> list[str]:
    return find_words(text.lower()) if text else []


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(cache.__getitem__, found), np.int64, len(found)).view(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; of the whole text if it has fewer."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out
