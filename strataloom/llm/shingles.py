"""Sets of word shingles as sorted 64-bit hashes, and their prefixes under a global order."""

from __future__ import annotations

import hashlib

import numpy as np

from strataloom.llm.hashing import batched, grams

WIDTH = 3


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Distinct shingles of ``width`` words, sorted; with fewer words, the whole sequence is one shingle."""
    out = []
    for h in batched(texts, bytes.lower):
        if len(h):
            g = grams(h, min(width, len(h)))
            g.sort()
            h = g[np.concatenate(([True], g[1:] != g[:-1]))]
        out.append(h)
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Order:
    """A global order of shingles: unmarked ones by hash, then marked ones, then frequent ones by their counts.

    ``marks`` is a bit table; two bits of a shingle's hash must be set. Any table gives a valid order.
    """

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, marks: np.ndarray | None = None):
        self.frequent, self.counts, self.marks = frequent, counts, marks

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(shingles), np.int64)
        if self.marks is not None:
            mask = np.uint64(8 * len(self.marks) - 1)
            both = np.ones(len(shingles), bool)
            for place in (shingles & mask, (shingles >> np.uint64(32)) & mask):
                both &= (self.marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            seen[both] = 1
        if len(self.frequent):
            at = np.searchsorted(self.frequent, shingles)
            at[at == len(self.frequent)] = 0
            seen = np.where(self.frequent[at] == shingles, self.counts[at] + 1, seen)
        return seen

    def first(self, shingles: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` shingles of a sorted set."""
        seen = self.weights(shingles)
        rare = shingles[seen == 0]
        if len(rare) >= length:
            return rare[:length]
        return shingles[np.lexsort((shingles, seen))[:length]]
