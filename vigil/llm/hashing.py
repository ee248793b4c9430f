"""Hashes of words and of stretches of bytes, over whole arrays at a time.

A stretch's hash is the sum of its bytes' random 64-bit values times powers of an odd base, modulo 2^64, so that the
hash of any stretch follows from two running sums; a final mix spreads it over all bits. Equal stretches always have
equal hashes, which is all that choosing anchors needs. Where unequal stretches must not meet, two such hashes with
other values and bases are taken together (128 bits).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(8)
def _values(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(2**63, dtype=np.uint64)) << 3 & (2**64 - 1) | 5  # 5 modulo 8: powers differ in low bits
    return rng.integers(2**64, size=256, dtype=np.uint64), base, pow(base, -1, 2**64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the base or its inverse, kept up to the longest text so far."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        x = _values(seed)[2 if inverse else 1]
        have = np.ones(1 << max(12, (n - 1).bit_length()), _U)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(len(have) - 1, x, _U), out=have[1:])
        _powers[seed, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread hashes over all bits (a bijection)."""
    h = h ^ h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Stretches:
    """Hashes of any stretches of a sequence of small numbers (bytes), or of 64-bit word hashes."""

    def __init__(self, items: np.ndarray, seed: int = 1):
        values = _values(seed)[0][items] if items.dtype == np.uint8 else mix(items ^ _U(seed))
        self.seed, self.n = seed, len(items)
        self.sums = np.zeros(len(items) + 1, _U)
        np.cumsum(values * _power(seed, len(items)), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(self.seed, self.n + 1, True)[start])

    def every(self, size: int) -> np.ndarray:
        """The hashes of all stretches of one size, by their start."""
        n = self.n - size + 1
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self.sums[size:] - self.sums[:n]) * _power(self.seed, n, True))


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word (run of other than ASCII white space)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[np.frombuffer(text, np.uint8)], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


#: Longer words are hashed by themselves, so that running sums stay short.
LONG_WORD = 4096


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each word, the same wherever it stands."""
    data, out, far = np.frombuffer(text, np.uint8), np.empty(len(start), _U), end - start > LONG_WORD
    for i in np.flatnonzero(far).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]], seed)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], far, [True])).view(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # runs of shorter words
        for c in range(a, b, 1 << 17):
            d = min(b, c + (1 << 17))
            base = start[c]
            out[c:d] = Stretches(data[base : end[d - 1]], seed).hash(start[c:d] - base, end[c:d] - base)
    return out


def window_least(h: np.ndarray, size: int) -> np.ndarray:
    """For each start of a window of ``size`` hashes, the place of its least one (by 32 bits), the first of equal
    ones. Least values so far, from both ends of blocks of the window's size, give those of any window."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keys = np.full(-(-len(h) // size) * size, np.iinfo(_U).max, _U)
    keys[: len(h)] = (h >> _U(32) << _U(32)) | np.arange(len(h), dtype=_U)
    blocks = keys.reshape(-1, size)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[size - 1 : size - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)


def runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows with the same place."""
    edge = np.flatnonzero(np.diff(place)) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge - 1, [len(place) - 1]))


def digest128(data: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(data)
    return signed(d >> 64), signed(d & (2**64 - 1))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x
