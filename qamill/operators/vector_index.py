"""Nearest vectors through a metric index (R3), and approximately through random projections.

A small table of pivots cuts the corpus into cells (nearest pivot); inside a cell rows are packed by
their distance to the pivot, so a block knows its ring. By the triangle inequality a vector nearer to
a query than ``r`` lies in a ring that meets [d - r, d + r], where d is the query's distance to the
pivot. A first look at the query's own ring gives r; then only blocks whose ring is met are read.
Queries are packed like the corpus and travel to the cells they need, by an equi-join on the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.operators.retrieval import _nearest, id_array, near_batch

PIVOTS = 64          # rows of the pivot table; the only vectors on the driver
BLOCK = 1024         # rows of a block
SLACK = 1e-9         # relative; rounding must not drop a block

RING = "array<struct<cell:int,low:double,high:double>>"


def _distances(vectors, centres: np.ndarray) -> np.ndarray:
    """Rows x pivots; blocks of rows bound the memory."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return np.concatenate([np.sqrt(((m[i:i + 256, None, :] - centres[None]) ** 2).sum(axis=2)) for i in range(0, len(m), 256)])


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(cell, low, high, block) from rows (id, vector, cell, low, high), sorted by ring inside each cell.

    Vectors and rings of a block are the bytes of doubles, so no batch of blocks outgrows its bytes.
    """
    block = T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("vectors", T.BinaryType()),
        T.StructField("lows", T.BinaryType()), T.StructField("highs", T.BinaryType())])
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()),
                           T.StructField("high", T.DoubleType()), T.StructField("block", block)])
    binary = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, lows, highs = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "low", "high"))
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []
            for first, end in zip(starts, [*starts[1:], len(cells)]):
                for at in range(first, end, size):
                    n = min(size, end - at)
                    ids, vectors = batch["id"].slice(at, n), batch["vector"].slice(at, n).flatten().to_numpy(zero_copy_only=False)
                    low, high = lows[at:at + n], highs[at:at + n]
                    packed = pa.StructArray.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                         *[pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes()], binary) for x in (vectors, low, high)]],
                        names=["ids", "vectors", "lows", "highs"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cells[at]], pa.int32()), pa.array([low.min()]), pa.array([high.max()]), packed],
                        names=["cell", "low", "high", "block"])

    spread = rows.repartitionByRange("cell", "low", F.xxhash64("id")).sortWithinPartitions("cell", "low", "id")
    return spread.select("id", "vector", "cell", "low", "high").mapInArrow(run, schema)


def _scan(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The k nearest of every pair of a query block ``q`` and a corpus block ``c``, over all blocks of a query.

    Half the width of a query's ring is the distance that no neighbour it needs is beyond; a ring without
    width tells nothing of it.
    """
    schema = T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType),
        T.StructField("doc_id", corpus.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def opened(block: pa.StructScalar) -> tuple[np.ndarray, ...]:
        ids = id_array(block["ids"].values)
        doubles = lambda name: np.frombuffer(block[name].as_buffer(), dtype=np.float64)
        return ids, doubles("vectors").reshape(len(ids), -1), doubles("lows"), doubles("highs")

    def reaches(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        rounding = 4 * np.finfo(np.float64).eps * np.maximum(np.abs(lows), np.abs(highs))
        return np.where(highs > lows, (((highs - lows) / 2 + rounding) * (1 + SLACK)) ** 2, np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, c in zip(batch["q"], batch["c"]):
                (q_ids, asked, lows, highs), (ids, held, low, high) = opened(q), opened(c)
                meets = (lows <= high.max()) & (highs >= low.min())
                if meets.any():
                    reach = reaches(lows[meets], highs[meets])
                    near = _nearest(q_ids[meets], asked[meets], ids, held, k, skip_self, reach)
                    yield near_batch(near, q["ids"].values.type, c["ids"].values.type)

    near = pairs.select("q", "c").mapInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """Pivots and packed blocks of a corpus of (id, vector); ids are unique, vectors of one length and not null."""

    def __init__(self, corpus: DataFrame, store, pivots: int = PIVOTS, block: int = BLOCK):
        self.corpus = corpus.select("id", F.col("vector").cast("array<double>").alias("vector"))
        self.block, self.store = block, store
        chosen = self.corpus.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()["vector"]
        self.centres = np.stack([np.asarray(v) for v in chosen]) if len(chosen) else np.zeros((0, 0))
        placed = self.homes(self.corpus) if len(self.centres) else None
        self.blocks = store(_packed(placed, block), "index") if placed is not None else None
        self.rings = {} if self.blocks is None else {r["cell"]: (r["low"], r["high"]) for r in self.blocks.groupBy("cell").agg(
            F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator()}

    def homes(self, rows: DataFrame) -> DataFrame:
        """Rows with the cell of their nearest pivot and their distance to it, as a ring without width."""
        centres = self.centres

        def run(vectors: pd.Series) -> pd.DataFrame:
            d = _distances(vectors, centres)
            at = d.argmin(axis=1)
            return pd.DataFrame({"cell": at.astype(np.int32), "low": d[np.arange(len(d)), at]})

        home = F.pandas_udf(run, "cell int, low double")("vector")
        return rows.withColumn("_h", home).select("id", "vector", "_h.cell", "_h.low", F.col("_h.low").alias("high"))

    def needed(self, rows: DataFrame) -> DataFrame:
        """Rows (id, vector, reach) once for every cell that can hold a vector within reach, with the ring to look at."""
        centres, rings = self.centres, self.rings
        gap = _distances(centres, centres)

        def run(vectors: pd.Series, reaches: pd.Series) -> pd.Series:
            out = []
            for d, r in zip(_distances(vectors, centres), reaches):
                own, r = int(d.argmin()), r * (1 + SLACK) + SLACK
                cells = []
                for c, (low, high) in rings.items():
                    # the query is this far from the plane between the two pivots, or farther from the cell
                    beyond = (d[c] ** 2 - d[own] ** 2) / (2 * gap[c, own]) if gap[c, own] else 0.0
                    if d[c] - r <= high and d[c] + r >= low and beyond <= r:
                        cells.append({"cell": c, "low": float(d[c] - r), "high": float(d[c] + r)})
                out.append(cells)
            return pd.Series(out)

        cells = F.pandas_udf(run, RING)("vector", "reach")
        return rows.select("id", "vector", F.explode(cells).alias("c")).select("id", "vector", "c.cell", "c.low", "c.high")

    def _met(self, asked: DataFrame) -> DataFrame:
        """Pairs of query blocks and corpus blocks of one cell whose rings meet."""
        q = asked.select("cell", F.col("low").alias("ql"), F.col("high").alias("qh"), F.col("block").alias("q"))
        c = self.blocks.select("cell", "low", "high", F.col("block").alias("c"))
        return q.join(c, "cell").where((F.col("ql") <= F.col("high")) & (F.col("qh") >= F.col("low")))

    def _rings(self, queries: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """Queries for the cells they need; the reach is the kth distance in the query's own ring."""
        rows = queries.select("id", F.col("vector").cast("array<double>").alias("vector"))
        first = _scan(self._met(_packed(self.homes(rows), self.block)), rows, self.corpus, k, skip_self)
        reach = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt("distance").alias("reach"))
        far = rows.join(reach, "id", "left").select("id", "vector", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        return self.needed(far)

    def top_k(self, queries: DataFrame, k: int = 5, skip_self: bool = False) -> DataFrame:
        """(query_id, doc_id, distance, rank), the ``k`` nearest by squared L2, exact, ties by id.

        Queries (id, vector) have unique ids. An empty corpus gives no rows.
        """
        if self.blocks is None:
            return queries.select(F.col("id").alias("query_id"), F.lit(None).cast(self.corpus.schema["id"].dataType).alias("doc_id"),
                                  F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).where(F.lit(False))
        return _scan(self._met(_packed(self._rings(queries, k, skip_self), self.block)), queries, self.corpus, k, skip_self)

    def visits(self, queries: DataFrame, k: int = 5, skip_self: bool = False) -> DataFrame:
        """One row: (visited, possible) pairs of a query and a corpus block that the search reads, of all."""
        rings = self._rings(queries, k, skip_self).select("cell", F.col("low").alias("ql"), F.col("high").alias("qh"))
        met = rings.join(self.blocks.select("cell", "low", "high"), "cell").where(
            (F.col("ql") <= F.col("high")) & (F.col("qh") >= F.col("low")))
        total = self.blocks.agg(F.count(F.lit(1)).alias("b")).join(queries.agg(F.count(F.lit(1)).alias("q")))
        return met.agg(F.count(F.lit(1)).alias("visited")).join(total).select("visited", (F.col("b") * F.col("q")).alias("possible"))


def lsh_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, skip_self: bool = False, bucket_length: float = 1.0,
              tables: int = 8, within: float = 2.0, seed: int = 7) -> DataFrame:
    """R3, approximate: the ``k`` nearest among vectors that share a bucket of a random projection.

    ``within`` is the largest distance that is looked at. Longer buckets and more tables raise recall and
    work; with the values given, unit vectors are found with a recall above 0.9.
    """
    vectors = lambda rows: rows.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(vectors(corpus))
    pairs = model.approxSimilarityJoin(vectors(queries), vectors(corpus), within, "d").select(
        F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("doc_id"), (F.col("d") * F.col("d")).alias("distance"))
    if skip_self:
        pairs = pairs.where("query_id <> doc_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "doc_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
