"""Word hashes and shingles in workers."""

from __future__ import annotations

import re

import numpy as np

_WORD = re.compile(r"\w+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Words a worker keeps the hash of.
CACHE = 400_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's lower-case words (letters, digits, underscores)."""
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (wrapping products)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total = total * _MULTIPLY + words[k : len(words) - n + 1 + k]
    return total


def shingles(text: str, n: int = 5, counted: bool = False):
    """Hashes of the shingles of ``n`` words, sorted and distinct (``counted``: and their counts); a shorter text is one shingle."""
    words = word_hashes(text)
    return np.unique(mix(windows(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64), return_counts=counted)
