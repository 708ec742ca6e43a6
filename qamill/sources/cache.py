"""The response cache as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(system: Column, question: Column) -> Column:
    return F.md5(F.concat(system, F.lit(":"), question))


def newest(cache: DataFrame, payload: list[str]) -> DataFrame:
    """The latest row of every key; a mergeable maximum, so hot keys shrink map-side."""
    best = F.max(F.struct("ts", *payload)).alias("best")
    return cache.groupBy("cache_key").agg(best).select(
        "cache_key", F.col("best.ts").alias("cached_ts"),
        *[F.col(f"best.{c}").alias(f"cached_{c}") for c in payload],
    )


def lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 86400,
           payload: tuple[str, ...] = ("answer",)) -> DataFrame:
    """Requests with ``hit`` and the cached payload.

    A row is a hit when the newest entry of its key is at most ``ttl_seconds`` old;
    a ttl of 0 or less never expires.
    """
    keyed = requests.withColumn("cache_key", cache_key(F.col("system"), F.col("question")))
    joined = keyed.join(newest(cache, list(payload)), "cache_key", "left")
    fresh = F.col("cached_ts").isNotNull()
    if ttl_seconds > 0:
        age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_ts").cast("timestamp"))
        fresh = fresh & (age <= F.lit(ttl_seconds * 1000000))
    hit = F.coalesce(fresh, F.lit(False))
    kept = [F.when(F.col("hit"), F.col(f"cached_{c}")).alias(f"cached_{c}") for c in payload]
    return joined.withColumn("hit", hit).select(*keyed.columns, "hit", *kept)


def misses(looked_up: DataFrame) -> DataFrame:
    """Requests that still have to be answered."""
    return looked_up.where(~F.col("hit"))


def cacheable(responses: DataFrame) -> DataFrame:
    """Rows worth keeping: successes only, keyed."""
    return responses.where("success").select(
        cache_key(F.col("system"), F.col("question")).alias("cache_key"),
        "system", "question", "answer", "ts",
    )
