"""Words, word shingles and MinHash values of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes remembered by one worker; beyond it the memory is emptied.
REMEMBERED = 250_000
#: Shingles hashed at a time, so that a very long text takes a bounded block.
BLOCK = 1024


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Runs of other bytes than space and \\x09-\\x0D, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it is shorter."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    by = _odd(size, 1)
    if len(h) < size:
        return _mix((h * by[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - size + 1
    acc = h[:n] * by[0]
    for k in range(1, size):
        acc = _mix(acc) + h[k : k + n] * by[k]
    return np.unique(_mix(acc))


def minhash(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least product with each multiplier, in 32 bits; shingles are random already."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(by), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(high), BLOCK):
        np.minimum(least, (high[i : i + BLOCK, None] * by).min(axis=0), out=least)
    return least


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)
