"""Hashes of many words at once: polynomials in the values of their bytes or characters, by prefix sums over arrays."""

from __future__ import annotations

import functools

import numpy as np

M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
S33, S32 = np.uint64(33), np.uint64(32)
#: Bytes or characters that are hashed at a time.
PIECE = 1 << 16
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


@functools.cache
def odd_values(size: int, seed: int) -> np.ndarray:
    """Random odd 64-bit numbers; not to be written to."""
    return np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    of = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
    return of(_BASE), of(pow(_BASE, -1, 1 << 64))  # of an odd number and of its inverse, modulo 2^64


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end]."""
    power, inverse = _powers(PIECE << max(0, (len(values) // PIECE).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
