"""Pieces of an index meet all blocks of queries, and none of them goes over the driver."""

from collections import Counter

import numpy as np
import pytest
from llm_cases import rows_of, vectors  # noqa: F401
from pyspark.sql import functions as F

from qamill.llm import blocks, vafile
from qamill.llm.vafile import FLOOR
from test_vectors import brute, sample


def packed(spark, n, parts, size):
    rows = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("v"))
    return blocks.pack(rows, parts, size, 1, lambda ids, matrix, _: (matrix.tobytes(), b""))


@pytest.mark.parametrize("lanes", [1, 3, 8])
def test_every_pair_of_blocks_meets_once_without_a_join(spark, lanes):
    def search(piece, query):
        ids, asked = blocks.ids_of(piece), blocks.ids_of(query)
        return {"query_id": np.repeat(asked, len(ids)), "bound": np.tile(ids, len(asked)).astype(float)}

    met = blocks.meet(packed(spark, 40, 8, 5), packed(spark, 12, 3, 4), lanes, search, FLOOR)
    got = Counter((r["query_id"], int(r["bound"])) for r in rows_of(met))
    assert got == Counter((q, i) for q in range(12) for i in range(40))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_lanes_hold_a_bounded_part_of_the_index():
    assert blocks.n_lanes(1, 1) == 1 and blocks.n_lanes(30, 1 << 20) == 30
    assert blocks.n_lanes(200, 1 << 20) == blocks.LANES
    assert blocks.n_lanes(100_000, 1 << 20) * (blocks.HELD >> 20) >= 100_000
    assert blocks.n_lanes(500, 1 << 40) == 500


def test_exact_search_with_many_pieces_in_a_lane(vectors, monkeypatch):
    monkeypatch.setattr(blocks, "LANES", 2)
    rows = sample(300, copies=40)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(vafile.exact_top_k(
        vectors(rows), index_rows=32, query_rows=3)))
    assert got == [(q, r, i, int(s)) for q, r, i, s in brute(rows, 50, 5, lambda v: np.floor(256 * v))]
