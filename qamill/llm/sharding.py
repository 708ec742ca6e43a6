"""Two-pass external shuffle of a table into shards.

First pass: seeded hashes scatter the rows uniformly over buckets that fit in memory.
Second pass: every bucket is one partition and one array, put into sorted order and then
permuted by Fisher-Yates (``shuffle``), and written. The place of a row in the whole order is
the rows of the buckets before it plus its place in the bucket; places are dealt to the shards
in turn, so row counts differ by one at most (law ``rows``).

``shuffle`` seeds its generator with the seed plus the number of the partition. A bucket *is* a
partition here (``repartitionById``) and its array is sorted first, so a repeated task draws the
same permutation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = 4096  # buckets whose counts are summed up in one window


def _offsets(counts: DataFrame) -> DataFrame:
    """(_bucket, _n) -> (_bucket, _before), summed in two levels so that no task sees all buckets."""
    cut = counts.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    groups = cut.groupBy("_group").agg(F.sum("_n").alias("_m"))
    groups = groups.select(
        F.col("_group").alias("_g"),
        (F.sum("_m").over(W.orderBy("_group")) - F.col("_m")).alias("_base"))
    inner = F.sum("_n").over(W.partitionBy("_group").orderBy("_bucket")) - F.col("_n")
    return cut.withColumn("_inner", inner).join(groups, F.col("_group") == F.col("_g")).select(
        F.col("_bucket").alias("_b"), (F.col("_inner") + F.col("_base")).alias("_before"))


def external_shuffle(
    rows: DataFrame, shards: int = 8, seed: int = 20, size: str = "size",
    bucket_bytes: int = 16 << 20, bucket_rows: int = 20_000,
) -> DataFrame:
    """All columns of ``rows`` plus ``shard`` and ``slot`` (from 0, without gaps, per shard).

    ``size`` names the bytes of a row. Buckets hold about ``bucket_bytes`` and at most about
    ``bucket_rows`` rows. Repeated rows are counted and numbered first, so that even a row that
    makes up a third of the table is scattered. Nulls count as values. An empty table gives an
    empty result. The outcome depends on the rows, the seed and the parameters only.
    """
    columns = rows.columns
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    buckets = max(1, math.ceil((total["b"] or 0) / bucket_bytes), math.ceil(total["n"] / bucket_rows))
    numbered = rows.groupBy(*[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    numbered = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    scattered = numbered.select(
        *columns, "_copy",
        F.pmod(F.xxhash64(*columns, "_copy", F.lit(seed)), F.lit(buckets)).cast("int").alias("_bucket"))
    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    record = F.struct(F.xxhash64(*columns, "_copy", F.lit(seed)).alias("_h"), *columns)
    held = scattered.repartitionById(buckets, F.col("_bucket")).groupBy("_bucket").agg(
        F.array_sort(F.collect_list(record)).alias("_rows"))
    placed = held.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_pos", "_row"))
    # one small row per bucket, so the rows are not shuffled a third time
    placed = placed.join(F.broadcast(_offsets(counts)), F.col("_bucket") == F.col("_b"))
    at = F.col("_before") + F.col("_pos")
    return placed.select(
        *[F.col("_row").getField(c).alias(c) for c in columns],
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"),
        F.floor(at / F.lit(shards)).cast("long").alias("slot"))


def _bytes(text) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffled_documents(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """(doc, shard, slot): the whole documents after both passes, ``doc`` the struct of their columns.

    Columns of maps have no order and no hash and stay behind.
    """
    whole = docs.drop(*[c for c, kind in docs.dtypes if "map<" in kind])
    rows = whole.select(F.struct("*").alias("doc"), _bytes(F.col("text")).alias("size"))
    return external_shuffle(rows, shards, seed).drop("size")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    The documents go through both passes with their texts, and size and crc32 are those of the text
    that arrives in the shard: its UTF-8 bytes plus 1 (crc32 0 without a text). ``grown_shard`` is
    null: the law is ``rows``. Extra columns of ``docs`` move along, whatever their names.
    """
    text = F.col("doc.text")
    return shuffled_documents(docs, shards, seed).select(
        F.col("doc.doc_id").alias("doc_id"), _bytes(text).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 20) -> None:
    """The whole documents as one folder of Parquet files per shard, each in slot order.

    Here the texts go through both passes, as the method says; a bucket's array holds
    ``bucket_bytes`` of them. ``docs`` must have no map column.
    """
    out = external_shuffle(docs.withColumn("_size", _bytes(F.col("text"))), shards, seed, "_size").drop("_size")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
