"""Content-defined anchors: every string of a given length holds one, at the same place wherever the string occurs."""

from __future__ import annotations

import numpy as np

GRAM = 32
#: Bits of the position in the key that is minimised; no Arrow buffer is longer.
POSITION_BITS = 31

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Hashes of any byte ranges of one buffer, from sums of its prefixes."""

    def __init__(self, buf: np.ndarray) -> None:
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(buf)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(buf) + 1)

    def hash(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(((self.sums[ends] - self.sums[begins]) * self.back[begins]) ^ (ends - begins).astype(np.uint64))


_KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hash of GRAM bytes given as four words of eight."""
    h = words[0] * _KEYS[0]
    for word, key in zip(words[1:], _KEYS[1:]):
        h ^= h >> np.uint64(29)
        h += word
        h *= key
    h ^= h >> np.uint64(32)
    return h


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling; overwrites ``keys``."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[:len(keys) - (width - have)], keys[width - have:]) if width > have else keys


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first, last): the strings of ``length`` bytes that start at first..last share the anchor.

    These ranges cover every start of every text once. The anchor of a string is its GRAM bytes with the smallest
    hash (the last of equal ones), so equal strings have it at the same place.
    """
    n = len(buf) - GRAM + 1
    if len(buf) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    at8 = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    keys = gram_hashes([at8[k:k + n] for k in range(0, GRAM, 8)])
    low = np.uint64((1 << POSITION_BITS) - 1)
    keys &= ~low
    keys |= low - np.arange(n, dtype=np.uint64)
    best = sliding_min(keys, length - GRAM + 1)
    # a range ends where the anchor changes, where a text ends and where its last string starts
    cut = np.zeros(len(best) + 1, bool)
    cut[1:-1] = best[1:] != best[:-1]
    whole = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    cut[offsets[offsets <= len(best)]] = True
    cut[whole[whole <= len(best)]] = True
    cut[[0, -1]] = True
    at = np.flatnonzero(cut)
    first, last = at[:-1], at[1:] - 1
    ends = offsets[np.searchsorted(offsets, first, "right")]
    inside = first + length <= ends
    first, last = first[inside], last[inside]
    where = int(low) - (best[first] & low).astype(np.int64)
    return gram_hashes([at8[where + k] for k in range(0, GRAM, 8)]), where, first, last
