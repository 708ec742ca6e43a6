"""What the training-data operators share: tables, words, and sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def first_per_key(rows: DataFrame, key: str, order: list[str | Column], n: int, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key in hashed order, then by ``order``.

    A hot key is cut into parts by the hash of the first ordering column; at most ``parts * n``
    rows of a key meet in one task.
    """
    h = F.xxhash64(order[0])
    cut = rows.withColumn("_h", h).withColumn("_part", F.pmod("_h", F.lit(parts)))
    near = cut.withColumn("_n", F.row_number().over(W.partitionBy(key, "_part").orderBy("_h", *order)))
    last = W.partitionBy(key).orderBy("_h", *order)
    kept = near.where(F.col("_n") <= n).withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n)
    return kept.select(*rows.columns)


def few(rows: DataFrame, most: int) -> list[dict]:
    """Rows of a small table on the driver. The bound is checked, not trusted: beyond it this fails."""
    found = rows.limit(most + 1).toArrow().to_pylist()
    if len(found) > most:
        raise ValueError(f"more than {most} rows of {rows.columns} for the driver")
    return found


def text_batches(
    batches: Iterator[pa.RecordBatch], rows: int = 256
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of few rows, so that long texts are not copied all at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
