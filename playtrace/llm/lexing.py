"""Hashes of the words and of runs of words of one text, in numpy.

A word is a run of bytes other than space and tab to carriage return. A word's hash is a polynomial over its bytes
modulo 2**64 with an odd base, taken from prefix sums, and then mixed; a run of words is hashed from its words' hashes.
Polynomials modulo a power of two agree on long words of a regular kind, whatever the base, so words over ``LONG_WORD``
bytes are hashed by BLAKE2b instead.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

LONG_WORD = 32
BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, kept for the next text."""
    if len(_POWERS[0]) <= n:
        n = max(n, 1 << 16)
        for place, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[place] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all of it."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of a text."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One hash for each word of a text; ``lower`` takes A-Z as a-z."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends = word_spans(raw)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # whole words, about a megabyte at a time: the tables of powers stay small
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        first, last = int(starts[at]), int(ends[upto - 1])
        power, inverse = _powers(last - first)
        letters = (_LOWER if lower else _SAME)[raw[first:last]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(letters * power[: last - first], out=sums[1:])
        s, e = starts[at:upto] - first, ends[at:upto] - first
        hashes[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        for k in np.flatnonzero(e - s > LONG_WORD):
            word = letters[s[k] : e[k]].astype(np.uint16).tobytes()
            hashes[at + k] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        at = upto
    return mix(hashes)


def run_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """One hash for each run of ``length`` consecutive words; none if there are fewer words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64((0xD1342543DE82EF95 + 2 * seed) | 1)
    total = words[:n].copy()
    for k in range(1, length):
        total *= base
        total += words[k : k + n]
    return mix(total ^ np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1))
