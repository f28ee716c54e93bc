"""Words of UTF-8 texts and hashes of runs of words, in numpy.

Words are runs of anything but the six ASCII white-space characters. Hashes of words are computed over
stretches of SLICE_BYTES, so a very long text costs a few numbers per word besides its own bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import SLICE_BYTES

#: Odd multipliers of the byte and word polynomials, a pair for each of two independent hashes.
FACTORS = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)))
#: Longer words are hashed on their own.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def rolled(hashes: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of every run of `length` hashes."""
    n = len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= factor
        out += hashes[i : i + n]
    return mix(out)


def _power_table(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. 2 * SLICE_BYTES of a byte multiplier modulo 2**64, and of its inverse."""
    if seed not in _powers:
        base = int(FACTORS[seed][0])
        tables = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(2 * SLICE_BYTES + 1, x, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[seed] = (tables[0], tables[1])
    return _powers[seed]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    edge = np.ones(len(text) + 2, bool)
    edge[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[::2], turns[1::2]


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of every word: a polynomial in its bytes by prefix sums, long words by XXH64."""
    out = np.zeros(len(starts), np.uint64)
    power, inverse = _power_table(seed)
    raw = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        size = int(ends[to - 1]) - base
        if size <= SLICE_BYTES:
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((raw[base : base + size] + np.uint64(1)) * power[:size], out=sums[1:])
            first = starts[at:to] - base
            out[at:to] = mix((sums[ends[at:to] - base] - sums[first]) * inverse[first])
        at = to
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]], seed)
    return out


def shingle_hashes(text: bytes | None, length: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `length` words; a shorter text has one run, one without words none."""
    text = text or b""
    starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return np.unique(rolled(word_hashes(text, starts, ends, 0), min(length, len(starts)), FACTORS[0][1]))
