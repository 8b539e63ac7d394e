"""Words and word n-grams in Python tasks, as the SQL forms in ``common`` have them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from fieldpulse.llm.common import WORD

_WORD = re.compile(WORD)
# Word hashes that a task keeps.
CACHE_WORDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> str:
    """A to Z lower-cased and nothing else, which is what bytes do."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_words(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text or ""))


def word_ngrams(text: str | None, n: int) -> frozenset:
    """The set of n-grams; a text of fewer words, but not none, is one n-gram."""
    found = find_words(text)
    if len(found) < n:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*[found[i:] for i in range(n)]))


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = value
        return value

    def of(self, found: list[str]) -> np.ndarray:
        get, make = self.known.get, self._hash
        return np.fromiter((get(w) or make(w) for w in found), np.uint64, len(found))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; of all words if they are fewer."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    places = len(hashes) - n + 1
    total = np.full(places, n, np.uint64)
    for i in range(n):
        total = (total ^ hashes[i : i + places]) * _P
        total ^= total >> np.uint64(32)
    return total


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The set of n-gram hashes, sorted."""
    return np.unique(rolling(hashes, n))
