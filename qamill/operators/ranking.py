"""Exact ranks and quantiles that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 1024  # of the bracket of a quantile


def hashed_rank(
    df: DataFrame, keys: list[str], pick: str, tie: str, digits: int = 3
) -> DataFrame:
    """Add ``rank_ix`` (from 1) by (``pick``, ``tie``) within ``keys``, and ``group_size``.

    ``pick`` is a hex digest, hence evenly spread. Its first ``digits`` digits cut
    every group, however hot, into 16^digits buckets: the counts of the buckets are
    summed up in a small table, and only rows of one bucket are sorted together.
    """
    cut = df.withColumn("_bucket", F.substring(pick, 1, digits))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = W.partitionBy(*keys).orderBy("_bucket")
    sizes = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        (F.sum("_n").over(by_bucket) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("group_size"),
    )
    inner = W.partitionBy(*keys, "_bucket").orderBy(pick, tie)
    same = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = cut.join(sizes, same)
    return joined.withColumn("rank_ix", F.row_number().over(inner) + F.col("_before")).drop(
        "_bucket", "_before", "_k_bucket", *[f"_k_{k}" for k in keys]
    )


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, q: float = 0.5, upper: bool = False,
    out: str = "quantile", accuracy: int = 10000,
) -> DataFrame:
    """Exact quantile per group, in three passes.

    The first pass is a mergeable sketch whose rank error is at most n/accuracy; it
    brackets the wanted ranks between two values. The second pass counts rows below
    the bracket and keeps only the distinct values inside it, about 4/accuracy of a
    group, for the exact answer. Linear interpolation, or the upper element
    (``sorted[floor(n*q)]``) with ``upper``.
    """
    rows = df.where(F.col(value).isNotNull())
    slack = 2.0 / accuracy
    ends = F.array(F.lit(max(q - slack, 0.0)), F.lit(min(q + slack, 1.0)))
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx(value, ends, accuracy).alias("_ends"),
        F.count(F.lit(1)).alias("_n"),
    )
    sketch = sketch.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_ends")[0].alias("_lo"), F.col("_ends")[1].alias("_hi"), "_n",
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    marked = rows.select(*keys, value).join(sketch, same).where(F.col(value) <= F.col("_hi"))
    if upper:
        at = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
        part = F.lit(0.0)
        lo_at = hi_at = at
    else:
        exact = (F.col("_n") - 1) * F.lit(float(q))
        lo_at, hi_at = F.floor(exact), F.ceil(exact)
        part = exact - F.floor(exact)
    # The bracket still grows with the group: cut it into ranges, and sort those only that hold a wanted rank.
    number = F.col(value).cast("double")
    low, high = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    cut = F.when(F.col(value) < F.col("_lo"), -1).when(high > low, F.floor((number - low) / (high - low) * RANGES)).otherwise(0)
    marked = marked.withColumn("_range", cut.cast("int"))
    ranges = marked.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_range"))
    ranges = ranges.withColumn("_to", upto - 1).withColumn("_from", F.col("_to") - F.col("_c") + 1)
    meets = lambda at: (at >= F.col("_from")) & (at <= F.col("_to"))
    ranges = ranges.where(meets(lo_at) | meets(hi_at)).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_range").alias("_r"), "_from")
    held_range = F.col("_range") == F.col("_r")
    for k in keys:
        held_range = held_range & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    counts = marked.join(ranges, held_range).groupBy(*keys, "_range", F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"), F.max("_from").alias("_from"))
    seen = W.partitionBy(*keys, "_range").orderBy("_v")
    ranked = counts.withColumn("_last", F.sum("_c").over(seen) - 1 + F.col("_from"))
    held = lambda at: (at <= F.col("_last")) & (at > F.col("_last") - F.col("_c"))
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(held(lo_at), F.col("_v"))).alias("_a"),
        F.max(F.when(held(hi_at), F.col("_v"))).alias("_b"),
        F.max(part).alias("_part"),
    )
    return picked.select(
        *keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias(out)
    )


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
