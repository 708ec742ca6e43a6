"""Dense retrieval and retrieval metrics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.functions import text as tx

K_VALUES = (1, 3, 5, 10)
TEXT_MATCH = 0.8
MEASURED = 1 << 15   # pairs whose differences are held at a time
REMEMBERED = 10_000  # query blocks of which a task knows the reach


def id_array(ids: pa.Array) -> np.ndarray:
    """Ids as an array that can be sorted; a null number is NaN."""
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=object)


def near_batch(near: pd.DataFrame, q_type: pa.DataType, c_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"query_id": q_type, "doc_id": c_type, "distance": pa.float64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(near[c].to_numpy(), kind, from_pandas=True) for c, kind in kinds.items()], names=list(kinds))


def vector_bytes(vectors: pa.Array) -> bytes:
    """The doubles of vectors of one length, as bytes."""
    doubles = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(set(vectors.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors must be of one length and not null")
    return np.ascontiguousarray(doubles, dtype=np.float64).tobytes()


def _pack(rows: DataFrame, name: str, size: int, parts: int) -> DataFrame:
    """Rows ``(id, vector)`` in blocks of at most ``size``, made where the rows lie and dealt out evenly.

    The vectors of a block are the bytes of doubles, so no batch of blocks outgrows its bytes.
    """
    schema = T.StructType([T.StructField(name, T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("vectors", T.BinaryType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                block = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["id"]),
                     pa.array([vector_bytes(part["vector"])], pa.binary())], names=["ids", "vectors"])
                yield pa.RecordBatch.from_arrays([block], names=[name])

    packed = rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)
    return packed.repartition(parts)


def _measured(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Squared distances row by row. Differences, not the expanded square: equal vectors must give exactly 0."""
    return ((matrix - queries) ** 2).sum(axis=1)


def _products(queries: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, float] | None:
    """All squared distances by one matrix product, and how far rounding may have moved them; None
    where that has no bound (huge, infinite or missing components)."""
    a, b = (queries ** 2).sum(axis=1), (matrix ** 2).sum(axis=1)
    largest = a.max(initial=0.0) + b.max(initial=0.0)
    if not largest < 1e300:
        return None
    dist = (-2 * queries) @ matrix.T  # the one large array, added to in place
    dist += a[:, None]
    dist += b
    return dist, (4 * queries.shape[1] + 16) * np.finfo(np.float64).eps * largest + 1e-290


def _nearest(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int,
             skip_self: bool, reach: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` nearest of one block of documents for each query of another, ties by id.

    Products leave the rows that may be among them, and only these are measured. ``reach`` holds a
    distance per query that the caller needs no neighbour beyond; it is lowered in place to that of the
    kth found.
    """
    if reach is None:
        reach = np.full(len(queries), np.inf)
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    if skip_self and q_ids.dtype.kind in "iuf" and ids.dtype.kind in "iuf":
        skip_self = np.isin(q_ids, ids).any()  # most blocks have no id in common
    own = q_ids[:, None] == ids[None, :] if skip_self else None
    rough = _products(queries, matrix)
    if rough is None:
        candidates = np.ones((len(queries), len(ids)), dtype=bool)
    else:
        dist, slack = rough
        if skip_self:
            dist[own] = np.inf
        limit = reach + slack
        far = np.flatnonzero(np.isinf(reach)) if len(ids) > k else []
        if len(far):
            limit[far] = np.partition(dist[far], k - 1, axis=1)[:, k - 1] + 2 * slack
        candidates = dist <= limit[:, None]
    if skip_self:
        candidates &= ~own
    row, col = np.nonzero(candidates)
    found = np.concatenate([np.zeros(0), *[
        _measured(queries[row[i:i + MEASURED]], matrix[col[i:i + MEASURED]]) for i in range(0, len(row), MEASURED)]])
    fine = np.isfinite(found)
    row, col, found = row[fine], col[fine], found[fine]
    order = np.lexsort((col, found, row))
    row, col, found = row[order], col[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == k - 1
    reach[row[last]] = np.minimum(reach[row[last]], found[last])
    kept = place < k
    return pd.DataFrame({"query_id": q_ids[row[kept]], "doc_id": ids[col[kept]], "distance": found[kept]})


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, skip_self: bool = False,
                query_block: int = 256, corpus_block: int = 4096) -> DataFrame:
    """The ``k`` nearest corpus vectors by squared L2 for each query, exact.

    Both inputs have ``(id, vector)``; ids may be of any sortable type and keep it. Either side is
    cut into blocks of bounded size where it lies, every query block meets every corpus block in
    one task, and only ``k`` rows per query leave it, so the pairs of rows are never written out.
    The blocks of both sides are dealt out so that all cores have pairs of parts, however few files
    the tables have. A task remembers how far the kth neighbour of a query was so far.
    One plan for all sizes; nothing is gathered on the driver or broadcast by hand.
    """
    near_schema = T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType),
        T.StructField("doc_id", corpus.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    parts = max(2, math.ceil(math.sqrt(4 * corpus.sparkSession.sparkContext.defaultParallelism)))
    blocks = _pack(corpus, "c", corpus_block, parts).hint("shuffle_replicate_nl").crossJoin(_pack(queries, "q", query_block, parts))

    def opened(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        ids = id_array(block["ids"].values)
        return ids, np.frombuffer(block["vectors"].as_buffer(), dtype=np.float64).reshape(len(ids), -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reaches: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for c, q in zip(batch["c"], batch["q"]):
                (ids, held), (q_ids, asked) = opened(c), opened(q)
                name = hashlib.blake2b(asked.tobytes() + repr(q_ids.tolist()).encode(), digest_size=16).digest()
                reach = reaches.pop(name, None)
                reach = np.full(len(asked), np.inf) if reach is None else reach
                near = _nearest(q_ids, asked, ids, held, k, skip_self, reach)
                if len(reaches) >= REMEMBERED:
                    reaches.pop(next(iter(reaches)))
                reaches[name] = reach
                yield near_batch(near, q["ids"].values.type, c["ids"].values.type)

    near = blocks.mapInArrow(scan, near_schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def relevance(contexts: Column, gold: Column, threshold: float = TEXT_MATCH) -> Column:
    """M4: one flag per retrieved context.

    A context with an id is relevant when the id is among the gold ids, and is never
    matched by text. A context without an id is relevant when its token overlap with
    any gold passage exceeds ``threshold``.
    """
    plain = lambda x: F.coalesce(x, F.lit(""))
    gold_side = F.struct(
        F.transform(gold, lambda g: plain(g["id"])).alias("ids"),
        F.transform(gold, lambda g: F.array_distinct(tx.tokens_strip(plain(g["text"])))).alias("tokens"))

    def flags(side: Column) -> Column:
        def flag(context: Column) -> Column:
            by_text = tx.bind(F.array_distinct(tx.tokens_strip(plain(context["text"]))), lambda tokens: F.exists(
                side["tokens"], lambda g: tx.jaccard(tokens, g) > threshold))
            return F.when(plain(context["id"]) != "", F.array_contains(side["ids"], context["id"])).otherwise(by_text)

        return F.transform(contexts, flag)

    return tx.bind(gold_side, flags)


def retrieval_scores(flags: Column, n_gold: Column, k_values=K_VALUES) -> dict[str, Column]:
    """M5–M7 and nDCG of one response from its relevance flags (row-local).

    Precision divides by the number of contexts actually in the top k.
    """
    n = F.size(flags)
    out: dict[str, Column] = {}
    for k in k_values:
        hits = F.size(F.filter(F.slice(flags, 1, k), lambda x: x))
        out[f"precision@{k}"] = F.when(n > 0, hits / F.least(F.lit(k), n)).otherwise(0.0)
        out[f"recall@{k}"] = F.when(n_gold > 0, hits / n_gold).otherwise(0.0)
        gains = F.aggregate(
            F.transform(
                F.slice(flags, 1, k),
                lambda x, i: F.when(x, 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0),
            ),
            F.lit(0.0), lambda a, x: a + x,
        )
        best = F.aggregate(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), n_gold), F.lit(1))),
                lambda i: 1.0 / F.log2(i + F.lit(1.0)),
            ),
            F.lit(0.0), lambda a, x: a + x,
        )
        out[f"ndcg@{k}"] = F.when(n_gold > 0, gains / best).otherwise(0.0)
    first = F.array_position(flags, F.lit(True))
    out["mrr"] = F.when(first > 0, 1.0 / first).otherwise(0.0)
    return out


def retrieval_metrics(responses: DataFrame, by: list[str], k_values=K_VALUES,
                      threshold: float = TEXT_MATCH) -> DataFrame:
    """M5–M7: macro averages over responses with contexts and gold, as a long table.

    Takes nested rows ``(…, contexts, gold)``; each is scored where it lies and only
    partial averages are shuffled.
    """
    usable = responses.where((F.size("contexts") > 0) & (F.size("gold") > 0))
    flagged = usable.select(
        *by, relevance(F.col("contexts"), F.col("gold"), threshold).alias("flags"),
        F.size("gold").alias("n_gold"),
    )
    return average_scores(flagged, by, k_values)


def average_scores(flagged: DataFrame, by: list[str], k_values=K_VALUES) -> DataFrame:
    """Averages of the per-response scores, unpivoted to ``(…, metric, value)``."""
    scores = retrieval_scores(F.col("flags"), F.col("n_gold"), k_values)
    wide = flagged.groupBy(*by).agg(*[F.avg(c).alias(name) for name, c in scores.items()])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("value")) for name in scores
    ])
    return wide.select(*by, F.inline(pairs))


def flags_by_label(near: DataFrame, labels: DataFrame) -> DataFrame:
    """Relevance flags of ranked hits where "relevant" means "same label".

    ``near`` is ``(query_id, doc_id, rank)``, at most k rows per query; ``labels`` is
    ``(id, label)``. A query's gold count is the size of its label, less itself.
    """
    per_label = labels.groupBy("label").agg(F.count(F.lit(1)).alias("label_size"))
    of_query = labels.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    of_doc = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("doc_label"))
    return (
        near.join(of_query, "query_id").join(of_doc, "doc_id")
        .groupBy("query_id", "query_label")
        .agg(F.sort_array(F.collect_list(
            F.struct("rank", (F.col("query_label") == F.col("doc_label")).alias("hit"))
        )).alias("ranked"))
        .join(per_label, F.col("query_label") == F.col("label"))
        .select("query_id", F.transform("ranked", lambda r: r["hit"]).alias("flags"),
                (F.col("label_size") - 1).cast("int").alias("n_gold"))
    )


def context_precision_recall(flags: Column, n_gold: Column) -> tuple[Column, Column]:
    """Share of all contexts that are relevant, and of gold passages found."""
    hits = F.size(F.filter(flags, lambda x: x))
    n = F.size(flags)
    precision = F.when(n > 0, hits / n).otherwise(0.0)
    return precision, F.when(n_gold > 0, hits / n_gold).otherwise(0.0)
