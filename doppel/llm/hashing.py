"""Hashes of byte strings and of their substrings, by array operations."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240517)
# one random 64-bit value per byte and an odd base with its inverse modulo 2**64
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BASE = int(_RNG.integers(1, 2**63)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, x, U))]) for x in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Substrings:
    """``of(start, end)`` hashes the substrings of ``data`` given by two arrays."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))
