"""64-bit word hashes for the operators that work on word windows in Arrow batches."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

CACHED_WORDS = 300_000


class WordHashes(dict):
    """Hashes of words, computed once a word while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text; ``bytes.split`` splits at the six ASCII spaces."""
    words = text.split() if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of MurmurHash3, a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts in a sorted array."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
