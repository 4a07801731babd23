"""Word shingles as 64-bit hashes, and MinHash over them. Plain numpy, used inside tasks."""

from __future__ import annotations

import math

import numpy as np
import xxhash

N_WORDS = 5
#: Words held by a memo before it starts anew; bounds a worker's memory.
MEMO_WORDS = 400_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word that comes back."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngrams(hashes: np.ndarray, n: int = N_WORDS) -> np.ndarray:
    """One hash for each window of n words, in order; none where there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= _MULT
        out += hashes[j : j + count]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def shingle_set(hashes: np.ndarray, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words than n, but some, is one shingle."""
    if 0 < len(hashes) < n:
        n = len(hashes)
    return np.unique(ngrams(hashes, n))


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall at the threshold."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"no banding of {most_hashes} hashes reaches recall {recall} at {threshold}")
    return best


class MinHash:
    """Band hashes of shingle sets; the hash functions are fixed by the seed."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 2**32, k, dtype=np.uint32)
        self.mult = rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each hash function; in steps that stay in the cache."""
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mult), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(high), 128):
            values = (high[at : at + 128, None] ^ self.flip) * self.mult
            np.minimum(least, values.min(axis=0), out=least)
        return least

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        """One signed 64-bit key a band, made of its number and its rows."""
        sig = self.signature(shingles).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
        for r in range(self.rows):
            key = (key ^ sig[:, r].astype(np.uint64)) * _MULT
            key ^= key >> np.uint64(32)
        return key.view(np.int64)
