"""Number-theoretic transform of many rows at once: exact whole numbers modulo a prime.

Rows of up to 64 numbers are one product with the matrix of powers of a root of unity; longer ones
are split into 64 shorter rows each. For short transforms the prime is so small (23 bits) that every
sum of products is exact in doubles, for long ones products are reduced one by one in 64-bit integers.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SHORT, LONG = 7 * 2**20 + 1, 15 * 2**27 + 1  # primes with roots of unity of order 2^20 and 2^27
GENERATOR = {SHORT: 3, LONG: 31}
RADIX = 64


def prime_for(size: int) -> int:
    if size <= 2**20:
        return SHORT
    if size <= 2**27:
        return LONG
    raise ValueError(f"a transform of {size} numbers is too long")


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    if x.dtype == np.int64:
        return x % p
    x = x - np.floor(x * (1.0 / p)) * p
    return x  # within one prime of [0, p), which every later step allows for


@cache
def _powers(size: int, n: int, m: int, p: int) -> np.ndarray:
    """root^(i j) for i < n, j < m, where root has order ``size``; a negative size inverts it."""
    root = pow(GENERATOR[p], (p - 1) // abs(size), p)
    if size < 0:
        root = pow(root, -1, p)
    kind = np.float64 if p == SHORT else np.int64
    table = np.ones(abs(size), dtype=np.int64)
    have = 1
    while have < abs(size):
        more = min(have, abs(size) - have)
        table[have:have + more] = table[:more] * pow(root, have, p) % p
        have += more
    at = np.arange(n, dtype=np.int64)[:, None] * np.arange(m, dtype=np.int64) % abs(size)
    return table[at].astype(kind)


def _matrix(x: np.ndarray, m: np.ndarray, p: int) -> np.ndarray:
    """x @ m modulo p along the last axis."""
    if p == SHORT:
        return _mod(x @ m, p)
    out = np.zeros((*x.shape[:-1], m.shape[1]), dtype=np.int64)
    for i in range(m.shape[0]):
        out = (out + x[..., i, None] * m[i]) % p
    return out


def transform(x: np.ndarray, p: int, inverse: bool = False) -> np.ndarray:
    """The transform of every row (last axis, a power of two long); the inverse is not divided by the length."""
    n = x.shape[-1]
    sign = -1 if inverse else 1
    if n <= RADIX:
        return _matrix(x, _powers(sign * n, n, n, p), p)
    rest = n // RADIX
    # x[a rest + b] -> first over a, then a twist by root^(b k), then over b
    rows = np.swapaxes(x.reshape(*x.shape[:-1], RADIX, rest), -1, -2)
    rows = _matrix(rows, _powers(sign * RADIX, RADIX, RADIX, p), p)
    rows = _mod(rows * _powers(sign * n, rest, RADIX, p), p)
    rows = transform(np.swapaxes(rows, -1, -2), p, inverse)      # [..., k, j] is entry k + 64 j
    return np.swapaxes(rows, -1, -2).reshape(*x.shape[:-1], n)


def distances(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences of each block with its window at every offset 0 to L - 1.

    ``blocks`` is rows x L, ``windows`` rows x 2L, of whole numbers from 0 to R - 1 with
    L R^2 below the prime, so the result is exact.
    """
    size = blocks.shape[1]
    p = prime_for(2 * size)
    kind = np.float64 if p == SHORT else np.int64
    own = (blocks.astype(np.int64) ** 2).sum(axis=1)
    sums = np.zeros((len(windows), 2 * size + 1), dtype=np.int64)
    np.cumsum(windows.astype(np.int64) ** 2, axis=1, out=sums[:, 1:])
    theirs = sums[:, size:2 * size] - sums[:, :size]
    flipped = np.zeros((len(blocks), 2 * size), dtype=kind)      # its product with a window is their correlation
    flipped[:, 0] = blocks[:, 0]
    flipped[:, size + 1:] = blocks[:, :0:-1]
    spectrum = _mod(transform(flipped, p) * transform(windows.astype(kind), p), p)
    both = transform(spectrum, p, inverse=True)[:, :size]
    both = _mod(both * kind(pow(2 * size, -1, p)), p)
    both = np.rint(both).astype(np.int64) % p
    return own[:, None] + theirs - 2 * both
