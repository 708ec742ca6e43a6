"""Exact top-k by vector-approximation files.

Components become cells (one byte) between marks that are quantiles of all components, so cells
are narrow where values are many. First pass: a scan of the cells alone bounds every score from
both sides; the kth best lower bound over all blocks is the query's floor. Second pass: vectors
whose upper bound reaches the floor are read in the order of their bounds, until the kth exact
score is above the next bound. Sums are exact integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm import blocks

CELLS = 256
CHUNK = 64  # exact vectors read at a time

FLOOR = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("bound", T.DoubleType())])
FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Least and largest possible inner product of each query with each approximated vector."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    lo, hi = low[cells].T, high[cells].T
    least, most = plus @ lo + minus @ hi, plus @ hi + minus @ lo
    slack = 1e-12 * np.maximum(np.abs(least), np.abs(most))  # rounding beyond 2^53
    return least - slack, most + slack


def exact_top_k(
    vectors: DataFrame, step: int = 50, k: int = 5, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
    index_rows: int = blocks.INDEX_ROWS, query_rows: int = blocks.QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query.

    Components are floor(scale * x). Queries are the rows whose id is divisible by ``step``; all
    rows with another id are candidates. Ties go to the smaller id; repeated rows compete one by
    one. Null vectors and those with null or non-finite components, or without an id, take no
    part; shorter vectors count as padded with zeros. Scores are 64-bit integers. Too few
    candidates: all of them; an empty table: no rows. Other columns are ignored.
    """
    rows = blocks.usable(vectors, id_col, vector_col)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
        F.count(F.when(blocks.every(F.col("id"), step), 1)).alias("q")).first()
    width = max(1, sizes["width"] or 1)
    quantiles = [i / CELLS for i in range(CELLS + 1)]
    marks = rows.select(F.explode("v").alias("x")).agg(F.percentile_approx("x", quantiles, 10000).alias("m")).first()["m"]
    marks = np.unique(np.array([0.0, *(marks or [])]))  # at most CELLS + 2 values
    # 0 pads short vectors; a cell [low, high] holds the whole numbers from one mark to the next
    outer = rows.agg(F.min(F.array_min("v")).alias("a"), F.max(F.array_max("v")).alias("b")).first()
    marks[0], top = min(marks[0], outer["a"] or 0.0), max(marks[-1], outer["b"] or 0.0)
    marks = np.unique(np.concatenate([marks[:1], marks[1:][np.arange(len(marks) - 1) < CELLS - 1]]))
    low, high = marks, np.append(marks[1:], top)
    index_parts, query_parts = blocks.n_parts(sizes["n"], index_rows), blocks.n_parts(sizes["q"], query_rows)
    lanes = blocks.n_lanes(index_parts, index_rows * width * 9)

    def cells_of(ids, matrix, _):
        cells = (np.searchsorted(marks, matrix, side="right") - 1).astype(np.uint8)
        return cells.tobytes(), matrix.tobytes()

    index = blocks.pack(rows, index_parts, index_rows, width, cells_of)
    asked = rows.where(blocks.every(F.col("id"), step))
    plain = lambda ids, matrix, floor: (matrix.tobytes(), floor.astype(np.float64).tobytes())

    def matrices(piece: dict, query: dict):
        ids, qids = blocks.ids_of(piece), blocks.ids_of(query)
        cells = np.frombuffer(piece["data"], dtype=np.uint8).reshape(-1, width)
        return ids, qids, cells, np.frombuffer(query["data"], dtype=np.float64).reshape(-1, width)

    def floors(piece: dict, query: dict):
        ids, qids, cells, wanted = matrices(piece, query)
        least, _ = _bounds(wanted, cells, low, high)
        least[qids[:, None] == ids[None, :]] = -np.inf
        take = min(k, least.shape[1])
        top = -np.partition(-least, take - 1, axis=1)[:, :take]
        keep = np.isfinite(top)
        return {"query_id": np.repeat(qids, keep.sum(axis=1)), "bound": top[keep]}

    first = blocks.meet(index.drop("extra").withColumn("extra", F.lit(b"")),
                        blocks.pack(asked, query_parts, query_rows, width, plain),
                        lanes, floors, FLOOR)
    order = W.partitionBy("query_id").orderBy(F.col("bound").desc())
    kth = first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    # fewer than k candidates anywhere: everything must be read
    kth = kth.groupBy("query_id").agg(F.min("bound").alias("bound"), F.max("_n").alias("_n")).select(
        F.col("query_id").alias("_q"), F.when(F.col("_n") == k, F.col("bound")).alias("floor"))
    asked = asked.join(kth, F.col("id") == F.col("_q"), "left").select(
        "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def exact(piece: dict, query: dict):
        ids, qids, cells, wanted = matrices(piece, query)
        floor = np.frombuffer(query["extra"], dtype=np.float64)
        vectors_ = np.frombuffer(piece["extra"], dtype=np.float64).reshape(-1, width)
        _, most = _bounds(wanted, cells, low, high)
        most[qids[:, None] == ids[None, :]] = -np.inf
        out_q, out_v, out_s = [], [], []
        for row in range(len(qids)):
            near = np.nonzero((most[row] >= floor[row]) & np.isfinite(most[row]))[0]
            near = near[np.lexsort((ids[near], -most[row, near]))]
            ask = wanted[row].astype(np.int64)
            scores = np.zeros(0, dtype=np.int64)
            for start in range(0, len(near), CHUNK):
                if len(scores) >= k and most[row, near[start]] < np.partition(scores, len(scores) - k)[len(scores) - k]:
                    break
                scores = np.append(scores, vectors_[near[start:start + CHUNK]].astype(np.int64) @ ask)
            near = near[:len(scores)]
            chosen = np.lexsort((ids[near], -scores))[:k]
            out_q.append(np.full(len(chosen), qids[row]))
            out_v.append(ids[near[chosen]])
            out_s.append(scores[chosen])
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, dtype=np.int64)
        return {"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)}

    second = blocks.meet(index, blocks.pack(asked, query_parts, query_rows, width, plain, aux="floor"),
                         lanes, exact, FOUND)
    return blocks.best(second, k)


ORACLE_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
