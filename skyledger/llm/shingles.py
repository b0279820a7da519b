"""Word shingles as sorted distinct 64-bit hashes, and 128-bit digests of whole sets."""

from __future__ import annotations

import numpy as np
import xxhash

#: Remembered words of a task; the memory is emptied when it is full.
REMEMBERED = 400_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words: A-Z in lower case, split at ASCII white space."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; none where there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = mix(out * GOLDEN + words[i : i + n])
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter sequence is one shingle, an empty one has none."""
    return np.unique(windows(words, min(size, len(words)))) if len(words) else words


def digest(own: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(own.tobytes())
