import math
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import rows_of, vectors  # noqa: F401

from qamill.llm import charpoly, registry, whitening
from qamill.llm.common import table


def plain_polynomial(matrix):
    """Faddeev–LeVerrier in fractions."""
    d = len(matrix)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) / k
    return [int(x) for x in c]


def gram(seed, d, rank=None):
    a = np.random.default_rng(seed).integers(-9, 10, (rank or d + 2, d))
    return [[int(x) for x in row] for row in a.T @ a]


@pytest.mark.parametrize("matrix", [gram(1, 1), gram(2, 2), gram(3, 5), gram(4, 6, 3), [[2, 0, 0], [0, 2, 0], [0, 0, 5]],
                                    [[0, 0, 0], [0, 4, 0], [0, 0, 0]]])
def test_polynomial_is_exact(spark, matrix):
    assert charpoly.characteristic(spark, matrix) == plain_polynomial(matrix)


def test_roots_and_multiplicities():
    poly = [1]
    for root in (0, 0, 3, 3, 3, 7, 8):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0])]
    assert [charpoly.roots_above(poly, t) for t in (-1, 0, 2, 3, 7, 8)] == [7, 5, 5, 2, 1, 0]
    assert charpoly.largest_roots(poly, 40, 9) == [(8, 1), (7, 1), (3, 3)]
    assert charpoly.largest_roots(poly, 40, 2) == [(8, 1), (7, 1)]


@pytest.mark.parametrize("matrix", [gram(5, 8), gram(6, 7, 4), [[2, 2], [2, 2]], [[2, 0, 0], [0, 2, 0], [0, 0, 5]],
                                    [[10**30 + 1, 0], [0, 10**30]], [[0, 0], [0, 0]]])
def test_vectors(spark, matrix):
    found = charpoly.leading(spark, matrix, 9)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    values = np.linalg.eigvalsh(np.array(matrix, dtype=float))[::-1]
    values = values[values > 1e-9 * max(values[0], 1)]
    assert np.allclose([share * trace for share, _ in found], values)
    v = np.array([v for _, v in found]).reshape(len(found), len(matrix))
    assert np.abs(v @ v.T - np.eye(len(found))).max(initial=0) < 1e-14
    for share, x in found:
        left = [sum(a * Fraction(b) for a, b in zip(row, x)) for row in matrix]
        assert all(abs(a - Fraction(share) * trace * Fraction(b)) <= Fraction(trace, 10**14) for a, b in zip(left, x))


def test_close_eigenvalues_keep_their_vectors(spark):
    """A gap of 1e-12 of the trace leaves doubles at a loss, not whole numbers."""
    matrix = [[10**24 + 5, 1, 0], [1, 10**24 + 5, 0], [0, 0, 10**23]]
    (_, a), (_, b), _ = charpoly.leading(spark, matrix, 3)
    assert np.allclose(np.abs(a), [math.sqrt(0.5), math.sqrt(0.5), 0], atol=1e-15) and a[0] * a[1] > 0 > b[0] * b[1]


def check(rows, values):
    """Rows of digest_columns against numpy and exact sums."""
    x = np.floor(64 * np.array(values)).astype(np.int64)
    n, d = x.shape
    e, v = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    z = ((x - x.mean(axis=0)) @ v[:, ::-1]) / np.sqrt(e[::-1])
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for r in rows:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert abs(abs(r["whitened"]) - abs(z[r["vec_id"], k])) < 1e-9
        assert r["explained"] == pytest.approx(e[::-1][k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    assert len(rows) == n * min(d, 32)


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    values = {r["vec_id"]: r["embedding"] for r in rows_of(table(spark, folder, "embeddings"))}
    order = sorted(values)
    assert order == list(range(len(order)))
    check(rows_of(registry.op13_whitening(spark, folder)), [values[i] for i in order])


def run(vectors, rows):  # noqa: F811
    return rows_of(whitening.digest_columns(whitening.whiten(vectors(rows))))


def test_small_tables(vectors):  # noqa: F811
    rng = np.random.default_rng(9)
    check(run(vectors, list(enumerate(rng.normal(0, 3, (40, 3)).tolist()))), np.random.default_rng(9).normal(0, 3, (40, 3)).astype(np.float32))


def test_dropped_rows_and_ties(vectors):  # noqa: F811
    fine = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 2.0]), (4, [3.0, 1.0])]
    broken = [(5, None), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 1.0]), (9, [1.0]), (10, [])]
    rows = run(vectors, fine + broken)
    assert sorted(str(r["vec_id"]) for r in rows) == ["1"] * 4 + ["4"] * 2 + ["None"] * 2
    assert {r["n"] for r in rows} == {4} and max(r["identity_error"] for r in rows) < 1e-12
    assert run(vectors, []) == [] and run(vectors, [(1, None), (2, [])]) == []


def test_without_variance(vectors):  # noqa: F811
    rows = run(vectors, [(1, [1.0, 5.0]), (2, [2.0, 5.0])])
    assert {(r["component"], r["whitened"] is None, r["explained"]) for r in rows} == {(1, False, 1.0), (2, True, 0.0)}
    rows = run(vectors, [(1, [1.0, 5.0])] * 3)
    assert len(rows) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    assert all(r["deviation"] == 0 for r in rows)


def test_far_entries_are_exact(vectors):  # noqa: F811
    big = [2.0**100, -(2.0**90), 1.0, 3.0]
    rows = run(vectors, [(i, [x, float(i)]) for i, x in enumerate(big)])
    assert len(rows) == 8 and all(r["deviation"] is None for r in rows) and rows[0]["identity_error"] < 1e-9
    x = [math.floor(64 * b) for b in big]
    whole = {r["id"]: int(r["deviation"]) for r in rows_of(whitening.whiten(vectors([(i, [b]) for i, b in enumerate(big)])))}
    assert whole == {i: (4 * x[i] - sum(x)) ** 2 for i in range(4)}
    assert whitening.products(np.array([[2**61, -5], [3, 2**40]]))[0, 0] == 2**122 + 9
