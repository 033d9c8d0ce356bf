"""Word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * _MULT[0]
    x = (x ^ (x >> np.uint64(29))) * _MULT[1]
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash per word, kept for repeated words up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but space and the controls 09-0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word runs; a shorter text is one run; no words, none."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = mix(np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws)))
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * _MULT[2] + h[i : len(h) - span + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())
