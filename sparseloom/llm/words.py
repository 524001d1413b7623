"""Words of texts as 64-bit hashes, and hashes of word sequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Words that a Python worker remembers.
MEMORY = 500_000


class WordHashes(dict):
    """Hash of a word (bytes), remembered; normal is applied before hashing."""

    def __init__(self, normal: Callable[[bytes], bytes] | None = None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(self.normal(word) if self.normal else word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space."""
    return text.encode("utf-8").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each value spread over the whole word (the splitmix64 finalizer; its numbers are fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; none if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n))
    for k in range(n):
        h = mixed(h + words[k : k + m])
    return h
