"""ST1/ST2: the cache key filter and the response summary on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qamill.operators.ranking import share
from qamill.session import scratch_path
from qamill.sources.cache import cache_key


def response_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def first_requests(stream: DataFrame, ttl: str = "1 day", time: str = "ts") -> DataFrame:
    """ST1: one row per cache key; a key is held for at least ``ttl`` and forgotten once
    the watermark has passed it.

    State is one entry per live key and is spread by the key's hash.
    """
    keyed = stream.withColumn("cache_key", cache_key(F.col("system"), F.col("question")))
    return keyed.withWatermark(time, ttl).dropDuplicatesWithinWatermark(["cache_key"])


def _summary(rows: DataFrame, width: str, time: str) -> DataFrame:
    ok = F.count_if("success")
    return rows.groupBy(F.window(time, width).alias("w"), "system").agg(
        F.count(F.lit(1)).alias("total_questions"), ok.alias("successful_queries"),
        share(ok, F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("latency"))), F.lit(0.0)).alias("average_latency"),
        F.min(F.when(F.col("success"), F.col("latency"))).alias("min_latency"),
        F.max(F.when(F.col("success"), F.col("latency"))).alias("max_latency"),
    ).select(F.col("w.start").alias("window_start"), "system", "total_questions", "successful_queries",
             "success_rate", "average_latency", "min_latency", "max_latency")


def window_summary(stream: DataFrame, width: str = "1 day", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """ST2: success rate and latency per tumbling window and system.

    The watermark lets windows older than ``delay`` leave the state.
    """
    return _summary(stream.withWatermark(time, delay), width, time)


def window_summary_batch(rows: DataFrame, width: str = "1 day", time: str = "ts") -> DataFrame:
    """The batch twin of ``window_summary``."""
    return _summary(rows, width, time)


def latency_counts(stream: DataFrame, width: str = "1 day", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """C6 on a stream: how often each latency of a success occurs per tumbling window and system.

    Counts per value are the mergeable state of any quantile; a window's state is its different values.
    """
    rows = stream.withWatermark(time, delay).where("success AND latency IS NOT NULL")
    return rows.groupBy(F.window(time, width).alias("w"), "system", "latency").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "system", "latency", "n")


def latency_quantiles(counts: DataFrame) -> DataFrame:
    """(window_start, system, count, mean, min, max, median) from counts per value; the median is the upper one.

    The sum behind the mean is added in decimals (12 places), so it does not depend on the order of the values.
    """
    window = W.partitionBy("window_start", "system")
    reached = F.sum("n").over(window.orderBy("latency").rowsBetween(W.unboundedPreceding, 0))
    rows = counts.withColumns({"_upto": reached, "_all": F.sum("n").over(window)})
    median = F.min(F.when(F.col("_upto") > F.expr("_all div 2"), F.col("latency")))
    return rows.groupBy("window_start", "system").agg(
        F.sum("n").alias("count"), share(F.sum(F.col("latency").cast("decimal(24,12)") * F.col("n").cast("decimal(13,0)")).cast("double"), F.sum("n")).alias("mean"),
        F.min("latency").alias("min"), F.max("latency").alias("max"), median.alias("median"))


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run over what is there and give the written table (append mode, exactly once)."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", scratch_path(spark, name + "-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run in update mode: every batch writes its changed rows under its own number, so
    a repeated batch overwrites itself; the newest row of each key is the result."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", scratch_path(spark, name + "-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return newest.select(*keys, "r.*")
