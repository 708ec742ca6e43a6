"""Eigenvalues and eigenvectors of a positive semidefinite integer matrix, through its exact characteristic polynomial.

The polynomial is found modulo many primes (reduction to Hessenberg form, then its recurrence; one
prime is one row of a Spark table) and put together by Chinese remaindering. All its roots are real,
so the number of roots above a point is exactly the number of sign changes of the polynomial's
Taylor coefficients there; this isolates the roots with their multiplicities, and bisection on exact
signs refines them. Eigenvectors come from inverse iteration on the near-singular matrix in whole
numbers of several hundred bits; the vectors of a multiple root are made orthogonal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

Matrix = list[list[int]]

BITS = 256      # bits of the trace after scaling: roots are known to 2^-BITS of it
GUARD = 64      # bits that a positive root keeps; with fewer, the scale is raised


# The polynomial -------------------------------------------------------------------------


def primes_below(limit: int, product: int) -> list[int]:
    """Primes under ``limit``, largest first, until their product exceeds ``product``."""
    found, reached, n = [], 1, limit - 1 | 1
    while reached <= product:
        n -= 2
        if all(pow(a, n - 1, n) == 1 for a in (2, 3, 5)) and all(n % f for f in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
            reached *= n
    return found


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient of the polynomial is larger: e_k(roots) <= trace^k / k! for roots >= 0."""
    return max(-(-trace ** k // math.factorial(k)) for k in range(size + 1))


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, e = np.ones_like(base), exponent.copy()
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return out


def residues(matrix: Matrix, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(xI - matrix), lowest first, modulo each prime (primes below 2^31)."""
    d = len(matrix)
    p = primes.astype(np.int64)
    h = np.array([[[x % int(q) for x in row] for row in matrix] for q in p], dtype=np.int64).reshape(len(p), d, d)
    p1, p2 = p[:, None], p[:, None, None]
    each = np.arange(len(p))
    for m in range(1, d - 1):
        # the first row from m on with an entry in column m - 1 becomes row m, likewise the column
        at = m + (h[:, m:, m - 1] != 0).argmax(axis=1)
        row = h[each, at].copy()
        h[each, at], h[:, m] = h[:, m].copy(), row
        column = h[each, :, at].copy()
        h[each, :, at] = h[:, :, m].copy()
        h[:, :, m] = column
        pivot = h[:, m, m - 1]
        u = h[:, m + 1:, m - 1] * _power(pivot, p - 2, p)[:, None] % p1  # 0 where the column is all zero
        h[:, m + 1:] = (h[:, m + 1:] - u[:, :, None] * h[:, m, None, :] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1:] * u[:, None, :] % p2).sum(axis=2)) % p1
    poly = np.zeros((len(p), d + 1, d + 1), dtype=np.int64)
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        # p_k = (x - h_kk) p_{k-1} - sum over i of h_{i,k} * (subdiagonal from i to k) * p_{i-1}
        weight, below = np.zeros((len(p), k), dtype=np.int64), np.ones(len(p), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            weight[:, i] = h[:, i, k - 1] * below % p
            if i:
                below = below * h[:, i, i - 1] % p
        taken = (weight[:, :, None] * poly[:, :k, :] % p2).sum(axis=1)
        poly[:, k, 1:] = poly[:, k - 1, :-1]
        poly[:, k] = (poly[:, k] - taken) % p1
    return poly[:, d]


def remaindered(columns: list[tuple[int, list[int]]]) -> list[int]:
    """Whole numbers in the symmetric range from their residues, (prime, residues) each."""
    product, values = 1, [0] * len(columns[0][1])
    for prime, rest in columns:
        inverse = pow(product % prime, -1, prime)
        values = [v + product * ((r - v) * inverse % prime) for v, r in zip(values, rest)]
        product *= prime
    return [v - product if 2 * v > product else v for v in values]


def characteristic(spark: SparkSession, matrix: Matrix) -> list[int]:
    """Coefficients of det(xI - matrix), lowest first; the primes are dealt over the executors."""
    d = len(matrix)
    need = 2 * coefficient_bound(sum(matrix[i][i] for i in range(d)), d) + 1
    primes = primes_below(1 << 31, need)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_numpy()
            for start in range(0, len(some), 16):
                part = some[start:start + 16]
                yield pa.RecordBatch.from_pydict({"p": part, "c": list(residues(shared.value, part))})

    table = spark.createDataFrame([(p,) for p in primes], "p long")
    parts = max(1, min(len(primes) // 16, spark.sparkContext.defaultParallelism))
    done = table.repartition(parts).mapInArrow(run, "p long, c array<long>").orderBy("p").toArrow()
    return remaindered(list(zip(done["p"].to_pylist(), done["c"].to_pylist())))


# The roots ------------------------------------------------------------------------------


def _around(poly: list[int], t: int) -> list[int]:
    """Taylor coefficients at ``t``, lowest first."""
    c = list(poly)
    n = len(c) - 1
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += t * c[j + 1]
    return c


def roots_above(poly: list[int], t: int) -> int:
    """How many roots exceed ``t``, with multiplicity; exact, since all roots are real."""
    signs = [x > 0 for x in _around(poly, t) if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], t: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * t + c
    return out


def _refined(poly: list[int], low: int, high: int) -> int:
    """The only root in (low, high], a simple one, rounded up to a whole number."""
    below = next(x for x in _around(poly, low) if x) > 0  # the sign between low and the root
    while high - low > 1:
        middle = (low + high) // 2
        v = _value(poly, middle)
        if v == 0:
            return middle
        low, high = (middle, high) if (v > 0) == below else (low, middle)
    return high


def largest_roots(poly: list[int], top: int, most: int) -> list[tuple[int, int]]:
    """(root rounded up, multiplicity) of the ``most`` largest roots in (0, top], falling; roots that share
    a unit interval count as one multiple root."""
    out, found = [], 0
    waiting = [(0, top, roots_above(poly, 0), 0)]
    while waiting and found < most:
        low, high, above_low, above_high = waiting.pop()
        count = above_low - above_high
        if not count:
            continue
        if count == 1 or high - low == 1:
            out.append((_refined(poly, low, high) if count == 1 else high, count))
            found += count
            continue
        middle = (low + high) // 2
        above = roots_above(poly, middle)
        waiting += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return out


# The vectors ----------------------------------------------------------------------------


def _orthonormal(vectors: list[list[int]], bits: int) -> list[list[int]]:
    """Gram-Schmidt in fixed point: vectors of length 2^bits."""
    out: list[list[int]] = []
    for v in vectors:
        high = max(abs(x) for x in v).bit_length()
        v = [x << (bits - high) if high < bits else x >> (high - bits) for x in v]
        for _ in range(2):
            for w in out:
                along = sum(a * b for a, b in zip(v, w)) >> bits
                v = [a - (along * b >> bits) for a, b in zip(v, w)]
        norm = math.isqrt(sum(x * x for x in v)) or 1
        out.append([(x << bits) // norm for x in v])
    return out


def null_vectors(matrix: Matrix, root: int, count: int, bits: int) -> list[list[float]]:
    """``count`` orthonormal vectors v with matrix v = root v, by inverse iteration in whole numbers of
    ``bits`` fraction bits; the largest component of each is positive."""
    d = len(matrix)
    a = np.array(matrix, dtype=object).reshape(d, d)
    for i in range(d):
        a[i, i] -= root
    order, factors = list(range(d)), []
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, best]] = a[[best, k]]
        order.append(best)
        if a[k, k] == 0:
            a[k, k] = 1
        u = (a[k + 1:, k] << bits) // a[k, k]
        a[k + 1:, k:] -= (u[:, None] * a[None, k, k:]) >> bits
        factors.append(u)
    swaps = order[d:]
    rng = np.random.default_rng(13)
    vectors = _orthonormal([[int(x) for x in rng.integers(-1 << 40, 1 << 40, d)] for _ in range(count)], bits)
    for _ in range(3):
        solved = []
        for v in vectors:
            b = np.array(v, dtype=object)
            for k in range(d):
                b[[k, swaps[k]]] = b[[swaps[k], k]]
                b[k + 1:] -= (factors[k] * b[k]) >> bits
            x = np.zeros(d, dtype=object)
            for k in range(d - 1, -1, -1):
                x[k] = ((b[k] << 2 * bits) - int((a[k, k + 1:] * x[k + 1:]).sum() if k + 1 < d else 0)) // a[k, k]
            solved.append([int(t) for t in x])
        vectors = _orthonormal(solved, bits)
    out = []
    for v in vectors:
        sign = 1 if max(v, key=abs) > 0 else -1
        out.append([sign * x / (1 << bits) for x in v])
    return out


def leading(spark: SparkSession, matrix: Matrix, most: int) -> list[tuple[float, list[float]]]:
    """(share of the trace, unit vector) of the ``most`` largest positive eigenvalues, falling.

    ``matrix`` is symmetric, positive semidefinite and of whole numbers. A matrix of zeros has none.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    if trace <= 0:
        return []
    poly = characteristic(spark, matrix)
    bits = BITS
    while True:
        up = max(0, bits - trace.bit_length())
        scaled = [c << up * (d - k) for k, c in enumerate(poly)]
        roots = largest_roots(scaled, trace << up, most)
        if not roots or roots[-1][0].bit_length() > GUARD:
            break
        bits *= 2  # a positive root is so small that it has too few bits
    bigger = [[x << up for x in row] for row in matrix]
    shared = spark.sparkContext.broadcast(bigger)
    width = (trace << up).bit_length() + 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ix, root, count in zip(*(c.to_pylist() for c in batch.columns)):
                found = null_vectors(shared.value, int(root), count, width)
                yield pa.RecordBatch.from_pydict({"ix": [ix] * len(found), "v": found})

    table = spark.createDataFrame([(i, str(r), m) for i, (r, m) in enumerate(roots)], "ix long, root string, n long")
    parts = max(1, min(len(roots), spark.sparkContext.defaultParallelism))
    rows = table.repartition(parts).mapInArrow(run, "ix long, v array<double>").orderBy("ix").toArrow()
    return [(roots[ix][0] / (trace << up), v) for ix, v in zip(rows["ix"].to_pylist(), rows["v"].to_pylist())][:most]
