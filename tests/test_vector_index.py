"""The metric index against all pairs, and the recall of the projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qamill.operators import retrieval as rt
from qamill.operators import vector_index as vi
from qamill.session import materialise


def frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, vector array<double>")


def clustered(n, d=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (groups, d))
    return centres[rng.integers(0, groups, n)] + rng.normal(0, 0.3, (n, d))


def plain(queries, corpus, k, skip_self):
    out = []
    for i, q in enumerate(queries):
        d = [(((q - c) ** 2).sum(), j) for j, c in enumerate(corpus) if not (skip_self and i == j)]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(sorted(d)[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["doc_id"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k,pivots,block", [(1, 4, 16), (5, 16, 32), (30, 8, 7)])
def test_exact_for_any_cut(spark, k, pivots, block):
    m = clustered(300)
    m[7] = m[3]  # equal vectors: the smaller id comes first
    m[100:110] += 40  # a far group
    rows = frame(spark, m)
    index = vi.Index(rows, materialise, pivots, block)
    assert found(index.top_k(rows, k, skip_self=True)) == plain(m, m, k, True)


def test_few_rows_and_equal_rows(spark):
    m = np.zeros((6, 3))
    rows = frame(spark, m)
    assert found(vi.Index(rows, materialise, 4, 2).top_k(rows, 9)) == plain(m, m, 9, False)
    assert vi.Index(rows.limit(0), materialise).top_k(rows, 3).count() == 0
    assert vi.Index(rows, materialise).top_k(rows.limit(0), 3).count() == 0


def test_blocks_are_skipped(spark):
    rows = frame(spark, clustered(2000))
    seen = vi.Index(rows, materialise, 24, 32).visits(rows, 5).first()
    assert seen["visited"] < 0.3 * seen["possible"]


def test_projections_find_nine_in_ten(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    exact = set(found(rt.dense_top_k(rows, rows, 5, skip_self=True).select("query_id", "doc_id", F.lit(1).alias("rank"))))
    near = set(found(vi.lsh_top_k(rows, rows, 5, skip_self=True).select("query_id", "doc_id", F.lit(1).alias("rank"))))
    assert len(exact & near) >= 0.9 * len(exact)


def test_products_leave_few_rows_to_measure(monkeypatch):
    rng = np.random.default_rng(2)
    held, counted = rng.normal(1e4, 1, (3000, 16)), []
    held[7], held[9], held[11] = held[3], held[3], np.nan
    measured = rt._measured
    monkeypatch.setattr(rt, "_measured", lambda q, m: (counted.append(len(m)), measured(q, m))[1])
    for fine in (held[:11], held[12:], held):  # the last block has a vector without distances
        counted.clear()
        ids = np.arange(len(fine))
        near = rt._nearest(ids[:50], fine[:50], ids, fine, 5, True)
        want = {(i, j): d for i, j, d in zip(near["query_id"], near["doc_id"], near["distance"])}
        for i in range(min(50, len(fine))):
            d = ((fine - fine[i]) ** 2).sum(axis=1)
            best = sorted((x, j) for j, x in enumerate(d) if j != i and np.isfinite(x))[:5]
            assert [want[i, j] for _, j in best] == [x for x, _ in best]
        if np.isfinite(fine).all() and len(fine) > 11:
            assert sum(counted) < 50 * len(fine) / 20


def test_one_file_is_searched_by_many_tasks(spark):
    rows = frame(spark, clustered(600)).coalesce(1)
    near = rt.dense_top_k(rows, rows, 5, skip_self=True, query_block=32, corpus_block=32)
    assert "CartesianProduct" in near._jdf.queryExecution().executedPlan().toString()
    m = clustered(600)
    assert found(near) == plain(m, m, 5, True)


def test_a_block_sends_only_what_is_within_reach(spark):
    """The kth distance in the query's own ring is known when other rings are read."""
    m, k = clustered(900), 5
    rows = frame(spark, m)
    index = vi.Index(rows, materialise, 12, 32)
    pairs = index._met(vi._packed(index._rings(rows, k, True), 32))
    near = vi._scan(pairs, rows, index.corpus, k, True)
    sent = near._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in sent.nodeName():
        sent = sent.children().head()
    counted = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent).count()
    assert counted < 900 * 3 * k
    assert found(near) == plain(m, m, k, True)
