"""Vectors in blocks: an index in pieces of bounded size, and queries in blocks that meet them all.

A stated set of queries against all rows is inherently a product; here it is one of blocks. The
pieces of the index are spread over lanes, one task each, and moved once; query blocks go to every
lane. There is no join, so no side can be taken for small and broadcast: a task holds the pieces of
its lane, whose bytes are bounded, and reads the query blocks one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_ROWS = 4096   # rows of an index piece
QUERY_ROWS = 1024   # rows of a query block
LANES = 64          # tasks that an index is worth, if it has as many pieces
HELD = 64 << 20     # bytes of the pieces of a lane

BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType()),
    T.StructField("extra", T.BinaryType())])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector whose components are all finite numbers, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine))


def n_parts(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def pack(
    rows: DataFrame, parts: int, size: int, width: int,
    make: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[bytes, bytes]], aux: str | None = None,
) -> DataFrame:
    """Blocks of at most ``size`` rows of (id, v), dealt evenly over ``parts``.

    Vectors shorter than ``width`` count as padded with zeros. ``make(ids, matrix, aux)`` gives the
    bytes of ``data`` and ``extra``.
    """
    columns = ["id", "v", *([aux] if aux else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        waiting = 0

        def block(count: int) -> pa.RecordBatch:
            nonlocal held, waiting
            everything = pa.Table.from_batches(held).combine_chunks()
            now, rest = everything.slice(0, count), everything.slice(count)
            held, waiting = rest.to_batches(), rest.num_rows
            ids = now["id"].to_numpy().astype(np.int64)
            lists = now["v"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(ids), width))
            inside = np.arange(width)[None, :] < lengths[:, None]
            matrix[inside] = lists.flatten().to_numpy(zero_copy_only=False)
            extra = now[aux].to_numpy() if aux else np.zeros(0)
            data, more = make(ids, matrix, extra)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "n": [len(ids)], "ids": [ids.tobytes()], "data": [data], "extra": [more]},
                schema=pa.schema([("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()),
                                  ("data", pa.binary()), ("extra", pa.binary())]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            while waiting >= size:
                yield block(size)
        if waiting:
            yield block(waiting)

    return rows.select(*columns).repartition(parts).mapInArrow(run, BLOCK)


def n_lanes(parts: int, piece: int) -> int:
    """Lanes of an index of ``parts`` pieces of ``piece`` bytes; a lane holds HELD bytes at most, or one piece."""
    return min(parts, max(LANES, math.ceil(parts / max(1, HELD // piece))))


def meet(
    index: DataFrame, queries: DataFrame, lanes: int,
    search: Callable[[dict, dict], dict[str, np.ndarray]], schema: T.StructType,
) -> DataFrame:
    """``search(index block, query block)`` for every pair of blocks, as rows of ``schema``."""
    names = ["n", "ids", "data", "extra"]
    held = index.select((F.col("part") % lanes).alias("lane"), F.lit(False).alias("asks"), *names)
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(True).alias("asks"), *names)
    met = held.unionByName(asked).repartitionById(lanes, F.col("lane")).sortWithinPartitions("asks")
    arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}[
        f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                if not one["asks"]:
                    pieces.append(one)
                    continue
                for piece in pieces:
                    found = search(piece, one)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[f.name], type=f.type) for f in arrow], schema=arrow)

    return met.select("asks", *names).mapInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller id."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def ids_of(block: dict) -> np.ndarray:
    return np.frombuffer(block["ids"], dtype=np.int64)


def every(id_column: Column, step: int) -> Column:
    return F.pmod(id_column, F.lit(step)) == 0
