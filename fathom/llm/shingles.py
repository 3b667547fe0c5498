"""Word shingles of whole texts, as hashes for signatures and as exact sets for verification."""

from __future__ import annotations

import numpy as np
import xxhash

from fathom.llm.common import worker_cache

#: Words whose hashes a worker keeps; a full table is emptied.
WORD_ENTRIES = 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of anything but space and the controls 9 to 13, which are what bytes split at."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """Distinct n-word shingles; of fewer words the whole sequence; of none nothing."""
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache("word hashes", dict)
    if len(known) > WORD_ENTRIES:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * _MIX[0] + own[i : len(own) - width + 1 + i])
    return np.unique(out)
