import numpy as np
import pytest
from llm_cases import rows_of, vectors  # noqa: F401

from qamill.llm import vafile, vptree

ODD = [(1000, None), (1020, []), (1040, [0.0, 0.0]), (1060, [None, 1.0]), (1080, [float("nan"), 1.0]),
       (1100, [float("inf"), 1.0]), (None, [1.0, 2.0]), (1120, [0.5])]


def sample(n, d=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d).astype(np.float32)]) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(copies)]


def brute(rows, step, k, value):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, value(np.pad(v, (0, width - len(v))))) for i, v in good]
    out = []
    for q, v in good:
        if q % step == 0:
            scores = sorted((-float((v * w).sum()), i) for i, w in good if i != q)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [sample(300, copies=40), sample(30) + ODD, sample(3), [(0, [1.0])], []], ids=len)
def test_exact_search(vectors, rows):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(vafile.exact_top_k(
        vectors(rows), index_rows=64, query_rows=4)))
    want = brute(rows, 50, 5, lambda v: np.floor(256 * v))
    assert got == [(q, r, i, int(s)) for q, r, i, s in want]


def test_exact_search_with_far_values(vectors):
    rows = sample(120, 4, 7)
    rows[7] = (7, [1e6, -1e6, 3.0, 0.0])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(vafile.exact_top_k(vectors(rows))))
    assert got == [(q, r, i, int(s)) for q, r, i, s in brute(rows, 50, 5, lambda v: np.floor(256 * v))]


@pytest.mark.parametrize("rows", [sample(400, copies=50), sample(40) + ODD, sample(3), []], ids=len)
def test_factor_one_is_exact(vectors, rows):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(vptree.nearest(
        vectors(rows), factor=1.0, index_rows=256, query_rows=8)))
    rows = [r for r in rows if r[1] is None or any(x != 0 for x in r[1])]
    want = brute(rows, 20, 20, lambda v: v)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_recall_of_the_query(spark):
    from conftest import SMALL
    from qamill.llm import registry
    folder = SMALL.replace("sf0.001", "sf0.1")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {(q, i) for q, _, i, _ in _fast(rows, 20, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in rows_of(registry.queries()["op5_vantage_tree"](spark, folder))}
    assert len(got) == len(want)
    assert len(got & want) >= 0.9 * len(want)


def _fast(rows, step, k):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], dtype=np.float64)
    for q in np.nonzero(ids % step == 0)[0]:
        s = matrix @ matrix[q]
        s[q] = -np.inf
        for rank, j in enumerate(np.lexsort((ids, -s))[:k]):
            yield ids[q], rank + 1, ids[j], s[j]


def test_skipping_grows_with_the_factor():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 10
    rows = np.concatenate([c + rng.normal(size=(100, 6)) for c in centres])
    norm2 = float((rows ** 2).sum(axis=1).max())
    lift = np.sqrt(np.maximum(0, norm2 - (rows ** 2).sum(axis=1)))
    tree = vptree.build(np.column_stack([rows, lift]), leaf=16)
    ids = np.arange(len(rows))
    queries = rows[::50]
    exact = -np.sort(-(queries @ rows.T - 1e18 * (ids[None, :] == ids[::50, None])), axis=1)[:, :5]
    last = 1.1
    for factor in (1.0, 2.0, 8.0):
        q, r = vptree.search(tree, rows, ids, queries, ids[::50], 5, factor, norm2)
        found = np.array([(rows[r[q == i]] @ queries[i]).sum() for i in range(len(queries))])
        share = (found / exact.sum(axis=1)).mean()
        assert share <= last + 1e-9
        last = share
        if factor == 1.0:
            assert np.allclose(share, 1.0)
