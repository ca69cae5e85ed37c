"""Words of whole texts, as bytes and as hashes, for the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Characters of text that one vectorised step works on; longer texts are taken in several steps or alone.
STEP_BYTES = 4_000_000
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def words(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased; none for a null text."""
    return data.lower().split() if data else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _S33)) * _C1
    x = (x ^ (x >> _S33)) * _C2
    return x ^ (x >> _S33)


def window_hashes(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One hash per window position of the word hashes standing at ``offsets`` from it."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        # An odd multiplier per place keeps the order of the words.
        out += h[o:o + n] * np.uint64(2 * (k + 1) * 0x9E3779B97F4A7C1 + 1)
    return mix(out)


def shingle_set(data: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one has none."""
    h = word_hashes(words(data))
    if not len(h):
        return h
    if len(h) < k:
        # Another tag keeps a short text apart from a full shingle.
        return mix(window_hashes(h, tuple(range(len(h)))) + np.uint64(len(h)))
    return np.unique(window_hashes(h, tuple(range(k))))


def steps(texts: list, size=len, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes together, at least one text each."""
    start = total = 0
    for i, t in enumerate(texts):
        n = size(t) if t is not None else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
