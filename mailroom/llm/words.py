"""Word shingles as numpy arrays, shared by the operators on word n-grams.

Words are the runs of ``\\w`` in the lowercased text. A text of ``n >= 5`` words
has the set of its 5-word shingles; one of 1 to 4 words has a single shingle
made of all of them; an empty or null text has none. Shingles are carried as
64-bit hashes (of word hashes), equal on every worker.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

SIZE = 5
WORDS = re.compile(r"\w+").findall
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
# Words remembered by one Python worker; beyond it the table starts anew.
_REMEMBER = 200_000


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBER:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_hash_of = _WordHash().__getitem__


def word_hashes(text: str | None) -> np.ndarray:
    words = WORDS(text.lower()) if text else []
    return np.fromiter(map(_hash_of, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit, for hashes compared by size."""
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hash of each shingle in text order, repeats included."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    n = min(size, len(h))
    m = len(h) - n + 1
    x = h[:m].copy()
    for k in range(1, n):
        x = x * _MUL + h[k:k + m]
    return mix(x + np.uint64(n))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, size))
