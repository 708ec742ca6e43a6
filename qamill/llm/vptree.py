"""Approximate nearest neighbours by inner product: vantage-point trees in every shard.

Rows of a shard are put in bands of like norm (by powers of two), each with a tree of its own, so
that a few long vectors do not flatten the distances of the others. Within a band the largest inner
product becomes the nearest distance by one more component: with M the largest norm of the band,
every vector gets sqrt(M^2 - |x|^2), every query 0; a query is taken at length M, which does not
change its order, and |q - x|^2 = 2 M^2 - 2 (M / |q|) q.x. A tree splits its rows at the median
distance from a vantage point and keeps the range of distances on either side. A search skips a
side if ``factor`` times the least distance the triangle inequality allows there is beyond the kth
best so far. Factor one is exact; larger factors skip more.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm import blocks

LEAF = 128
FACTOR = 1.5
ERROR = 8 * np.finfo(float).eps  # of a sum of products, per component and relative to both norms

FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def build(points: np.ndarray, leaf: int = LEAF, seed: int = 5) -> dict:
    """The order of the rows and the nodes: (start, end, vantage row, inner node, outer node, ranges)."""
    order = np.arange(len(points))
    rng = np.random.default_rng(seed)
    nodes: list[list] = []

    def grow(start: int, end: int) -> int:
        number = len(nodes)
        nodes.append([start, end, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
        if end - start > leaf:
            chosen = start + int(rng.integers(end - start))
            order[[start, chosen]] = order[[chosen, start]]
            inside = order[start + 1:end]
            away = np.sqrt(np.maximum(0.0, ((points[inside] - points[order[start]]) ** 2).sum(axis=1)))
            half = len(inside) // 2
            rank = np.argpartition(away, half)
            order[start + 1:end] = inside[rank]
            near, far = away[rank[:half]], away[rank[half:]]
            middle = start + 1 + half
            left, right = grow(start + 1, middle), grow(middle, end)
            nodes[number] = [start, end, start, left, right, near.min(), near.max(), far.min(), far.max()]
        return number

    grow(0, len(points))
    return {"order": order, "nodes": nodes}


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal numbers."""
    return np.einsum("ij,ij->i", left, right)


def bands(matrix: np.ndarray) -> list[tuple[np.ndarray, float, dict]]:
    """(rows, M^2, tree) of every band of norms, the longest vectors first."""
    lengths = np.linalg.norm(matrix, axis=1)
    band = np.frexp(lengths)[1]
    out = []
    for b in np.unique(band)[::-1]:
        at = np.nonzero(band == b)[0]
        norm2 = float((lengths[at] ** 2).max())
        lift = np.sqrt(np.maximum(0.0, norm2 - lengths[at] ** 2))
        out.append((at, norm2, build(np.column_stack([matrix[at], lift]))))
    return out


def search_bands(pieces: list, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray,
                 k: int, factor: float):
    """As ``search`` over all bands: (query row, row of ``rows``, product) of at least the k best found."""
    query, row, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    floor = np.full(len(queries), -np.inf)
    for at, norm2, tree in pieces:
        q, r = search(tree, rows[at], ids[at], queries, qids, k, factor, norm2, floor)
        query, row = np.concatenate([query, q]), np.concatenate([row, at[r]])
        score = np.concatenate([score, scores(queries[q], rows[at[r]])])
        order = np.lexsort((ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        floor[query[rank == k - 1]] = score[rank == k - 1]
        query, row, score = (x[rank < k] for x in (query, row, score))
    return query, row, score


def search(tree: dict, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray,
           k: int, factor: float, norm2: float, floor: np.ndarray | None = None):
    """(query row, row of ``rows``) of the k best found per query; own ids are left out.

    ``rows`` and ``queries`` are the original vectors; ``norm2`` is M^2. ``floor``, if given, is the
    kth best product of each query found elsewhere; what is below need not be found.
    """
    order, nodes = tree["order"], tree["nodes"]
    rows, ids = rows[order], ids[order]
    lengths, sizes = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    scale = np.sqrt(norm2) / np.maximum(lengths, 1e-300)
    error = ERROR * (rows.shape[1] + 8)
    slack = 4 * error * norm2  # of a squared distance
    best = np.full((len(queries), k), -np.inf)
    who = np.full((len(queries), k), -1)
    place = np.full((len(queries), k), np.iinfo(np.int64).max)  # ids, for ties
    if floor is None:
        floor = np.full(len(queries), -np.inf)

    def least(active: np.ndarray) -> np.ndarray:
        return np.maximum(best[active, k - 1], floor[active])

    def offer(active: np.ndarray, start: int, end: int) -> None:
        """Fast products tell who may be among the best; the scores themselves then decide."""
        rough = queries[active] @ rows[start:end].T
        hope = rough + error * lengths[active][:, None] * sizes[None, start:end] >= least(active)[:, None]
        hope &= qids[active][:, None] != ids[None, start:end]
        some = hope.any(axis=1)
        active, hope = active[some], hope[some]
        if not len(active):
            return
        products = np.full(hope.shape, -np.inf)
        i, j = np.nonzero(hope)
        products[i, j] = scores(queries[active[i]], rows[start + j])
        values = np.concatenate([best[active], products], axis=1)
        names = np.concatenate([place[active], np.broadcast_to(ids[start:end], products.shape)], axis=1)
        spots = np.concatenate([who[active], np.broadcast_to(np.arange(start, end), products.shape)], axis=1)
        top = np.lexsort((names, -values), axis=1)[:, :k]
        best[active] = np.take_along_axis(values, top, axis=1)
        place[active] = np.take_along_axis(names, top, axis=1)
        who[active] = np.where(np.isfinite(best[active]), np.take_along_axis(spots, top, axis=1), -1)

    def reach(active: np.ndarray) -> np.ndarray:
        kth = least(active)
        known = np.isfinite(kth)
        square = 2 * norm2 - 2 * scale[active] * np.where(known, kth, 0.0)
        return np.where(known, np.sqrt(np.maximum(0.0, square + slack)), np.inf)

    def visit(number: int, active: np.ndarray) -> None:
        start, end, vantage, left, right, n_lo, n_hi, f_lo, f_hi = nodes[number]
        if not len(active) or start == end:
            return
        if vantage < 0:
            offer(active, start, end)
            return
        offer(active, vantage, vantage + 1)
        # a query has no extra component, so its distance to the vantage point follows from the product
        square = 2 * norm2 - 2 * scale[active] * (queries[active] @ rows[vantage])
        low, high = np.sqrt(np.maximum(0.0, square - slack)), np.sqrt(np.maximum(0.0, square + slack))
        outside = lambda lo, hi: np.maximum(0.0, np.maximum(low - hi * (1 + error), lo * (1 - error) - high))
        near_bound, far_bound = outside(n_lo, n_hi), outside(f_lo, f_hi)
        first_near = near_bound <= far_bound
        open_ = lambda bound, which: which[factor * bound[which] <= reach(active[which])]
        a, b = np.nonzero(first_near)[0], np.nonzero(~first_near)[0]
        visit(left, active[open_(near_bound, a)])
        visit(right, active[open_(far_bound, b)])
        visit(right, active[open_(far_bound, a)])
        visit(left, active[open_(near_bound, b)])

    visit(0, np.arange(len(queries)))
    query, slot = np.nonzero(who >= 0)
    return query, order[who[query, slot]]


def nearest(
    vectors: DataFrame, step: int = 20, k: int = 20, factor: float = FACTOR,
    id_col: str = "vec_id", vector_col: str = "embedding",
    index_rows: int = blocks.INDEX_ROWS, query_rows: int = blocks.QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest inner products found.

    Queries are the rows whose id is divisible by ``step``; all rows with another id are indexed.
    Shards hold at most ``index_rows`` rows, each with trees of its own; the k best of every shard
    are merged. Scores are the inner products in double precision, ties go to the smaller id.
    Vectors that are null, all zero, or hold null or non-finite components, and rows without an
    id, take no part; shorter vectors count as padded with zeros. Repeated rows compete one by
    one. Fewer candidates than k: all of them; an empty table: no rows. Other columns are ignored.
    """
    rows = blocks.usable(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
        F.count(F.when(blocks.every(F.col("id"), step), 1)).alias("q")).first()
    width = max(1, sizes["width"] or 1)
    shards, query_parts = blocks.n_parts(sizes["n"], index_rows), blocks.n_parts(sizes["q"], query_rows)

    def index_shard(ids, matrix, _):
        return matrix.tobytes(), pickle.dumps(bands(matrix))

    def one(piece: dict, query: dict):
        ids, qids = blocks.ids_of(piece), blocks.ids_of(query)
        matrix = np.frombuffer(piece["data"]).reshape(-1, width)
        wanted = np.frombuffer(query["data"]).reshape(-1, width)
        q, r, score = search_bands(pickle.loads(piece["extra"]), matrix, ids, wanted, qids, k, factor)
        return {"query_id": qids[q], "vec_id": ids[r], "score": score}

    index = blocks.pack(rows, shards, index_rows, width, index_shard)
    asked = blocks.pack(rows.where(blocks.every(F.col("id"), step)), query_parts, query_rows, width,
                        lambda ids, matrix, _: (matrix.tobytes(), b""))
    return blocks.best(blocks.meet(index, asked, blocks.n_lanes(shards, index_rows * width * 9), one, FOUND), k)
