"""One vector far longer than the others leaves the neighbours of ordinary queries as they are."""

import numpy as np
import pytest
from llm_cases import rows_of, vectors  # noqa: F401
from test_vectors import brute

from qamill.llm import vptree


def unit_rows(far):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    matrix = np.repeat(centres, 50, axis=0) + 0.3 * rng.normal(size=(600, 8))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(matrix)]
    rows[7] = (7, [float(np.float32(far * x)) for x in matrix[7]])
    return rows + [(600 + i, rows[3][1]) for i in range(30)]


def found(vectors, rows, factor):
    return sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows_of(vptree.nearest(
        vectors(rows), factor=factor, index_rows=256, query_rows=16)))


@pytest.mark.parametrize("far", [1e4, 1e6])
def test_exact_and_recall_with_one_far_vector(vectors, far):
    rows = unit_rows(far)
    want = [r[:3] for r in brute(rows, 20, 20, lambda v: v)]
    assert found(vectors, rows, 1.0) == want
    got = {(q, i) for q, _, i in found(vectors, rows, vptree.FACTOR)}
    share = len(got & {(q, i) for q, _, i in want}) / len(want)
    print("recall", far, share)
    assert share >= 0.9
