"""Vectorised hashes of byte ranges, by prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A fixed odd random number for each byte."""
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept for the largest n so far."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Ranges:
    """Hashes of ranges [i, j) of ``data``: bytes, or 64-bit values of longer units; equal data give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((byte_values()[data] if data.dtype == np.uint8 else data) * powers(BASE, len(data)), out=self.prefix[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def raw(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.prefix[j] - self.prefix[i]) * self.back[i]

    def grams(self, size: int) -> np.ndarray:
        """Mixed hashes of all ranges of ``size`` bytes, by start."""
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:n]) * self.back[:n]) if n > 0 else np.empty(0, np.uint64)
