"""Rank that travels far, and small ranks beside a very large one."""

import numpy as np
from llm_cases import rows_of
from test_native import ranks

from qamill.llm import linkgraph


def propagated(spark, seeds, edges, **how):
    rows = rows_of(linkgraph.propagate(
        spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"),
        spark.createDataFrame(edges, "src string, dst string, links long"), **how))
    return {r["host"]: (r["trust"], r["distrust"]) for r in rows}


def test_rank_passes_more_than_twelve_links(spark):
    edges = [(f"h{i + 1}", f"h{i}", 1) for i in range(16)]
    got = propagated(spark, {"h0": (0.0, 1e6)}, edges)
    assert np.isclose(got["h13"][1], 1e6 * 0.15 * 0.85 ** 13) and got["h16"][1] > 0


def test_a_large_seed_does_not_settle_small_hosts(spark):
    seeds = {"big": (0.0, 1e8), "a": (2.0, 5.0), "b": (1.0, 0.0)}
    edges = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 1), ("d", "d2", 1)]
    got = propagated(spark, seeds, edges, damping=0.5, settled=1e-4)
    for host, pair in ranks(seeds, edges, 0.5, 200).items():
        assert np.allclose(got.get(host, (0.0, 0.0)), pair, rtol=0, atol=1e-4)
