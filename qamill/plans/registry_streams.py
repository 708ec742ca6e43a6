"""Registered queries: streams (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.plans.fixtures import cte, table
from qamill.streaming import expiry
from qamill.streaming import responses as st

QUERIES, ORACLES = {}, {}


def _events(spark, sf):
    """The event table as a stream of responses."""
    stream = st.response_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    return stream.select(
        F.concat(F.lit("sys"), (F.col("user_id") % 3).cast("string")).alias("system"),
        F.concat(F.lit("q"), F.col("user_id").cast("string"), F.col("event_type")).alias("question"),
        (F.col("event_type") != "error").alias("success"), (F.col("value") / 100).alias("latency"), F.col("ts").cast("timestamp").alias("ts"))


def stream_first_requests(spark, sf):
    """ST1 with a ttl longer than the log, so that every key passes once."""
    out = st.run_append(st.first_requests(_events(spark, sf), "10000 days"), "first-requests")
    return out.select("system", "question", "cache_key")


def stream_window_summary(spark, sf):
    out = st.run_update(st.window_summary(_events(spark, sf)), "window-summary", ["window_start", "system"])
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "system", "total_questions", "successful_queries",
        F.round("success_rate", 6).alias("success_rate"), F.round("average_latency", 6).alias("average_latency"),
        "min_latency", "max_latency")


QUERIES["stream_first_requests"] = stream_first_requests
ORACLES["stream_first_requests"] = """
SELECT DISTINCT system, question, md5(concat(system, ':', question)) AS cache_key FROM (
  SELECT concat('sys', CAST(user_id % 3 AS STRING)) AS system, concat('q', CAST(user_id AS STRING), event_type) AS question FROM events) e"""
QUERIES["stream_window_summary"] = stream_window_summary
ORACLES["stream_window_summary"] = f"""{cte('v_responses')}
SELECT strftime(ts, '%Y-%m-%d') AS day, system, count(*) AS total_questions, CAST(sum(CAST(success AS INT)) AS BIGINT) AS successful_queries,
  round(avg(CAST(success AS INT)), 6) AS success_rate, round(coalesce(avg(CASE WHEN success THEN latency END), 0), 6) AS average_latency,
  min(CASE WHEN success THEN latency END) AS min_latency, max(CASE WHEN success THEN latency END) AS max_latency
FROM v_responses GROUP BY day, system"""


def stream_cache_hits(spark, sf):
    """ST1 with a ttl of one day over shared questions."""
    asked = _events(spark, sf).withColumn("question", F.regexp_replace("question", "[a-z_]+$", ""))
    with expiry.rocks_state(spark):
        return st.run_append(expiry.cache_hits(asked, 86400), "cache-hits").select(
            "cache_key", F.unix_micros("ts").alias("micros"), "success", "hit")


def stream_latency_median(spark, sf):
    """ST2 with the upper median of C6."""
    counts = st.run_update(st.latency_counts(_events(spark, sf)), "latency-counts", ["window_start", "system", "latency"])
    return st.latency_quantiles(counts).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "system", "count", F.round("mean", 6).alias("mean"), "min", "max", "median")


QUERIES["stream_cache_hits"] = stream_cache_hits
ORACLES["stream_cache_hits"] = """
WITH RECURSIVE e AS (
  SELECT md5(concat('sys', CAST(user_id % 3 AS STRING), ':', regexp_replace(concat('q', CAST(user_id AS STRING), event_type), '[a-z_]+$', ''))) AS cache_key,
         epoch_us(ts) AS micros, event_type <> 'error' AS success FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY micros, success DESC) AS rn FROM e),
stored(cache_key, micros) AS (
  SELECT cache_key, min(micros) FROM o WHERE success GROUP BY cache_key
  UNION ALL
  SELECT s.cache_key, min(o.micros) FROM stored s JOIN o ON o.cache_key = s.cache_key AND o.success AND o.micros > s.micros + 86400000000
  GROUP BY s.cache_key),
first AS (SELECT s.cache_key, s.micros, min(o.rn) AS rn FROM stored s JOIN o ON o.cache_key = s.cache_key AND o.micros = s.micros AND o.success GROUP BY ALL)
SELECT o.cache_key, o.micros, o.success, EXISTS (
  SELECT 1 FROM first f WHERE f.cache_key = o.cache_key AND f.rn < o.rn AND o.micros - f.micros <= 86400000000) AS hit FROM o"""
QUERIES["stream_latency_median"] = stream_latency_median
ORACLES["stream_latency_median"] = f"""{cte('v_responses')}
SELECT strftime(ts, '%Y-%m-%d') AS day, system, count(*) AS count, round(CAST(sum(CAST(latency AS DECIMAL(24, 12))) AS DOUBLE) / count(*), 6) AS mean, min(latency) AS min, max(latency) AS max,
  list_sort(list(latency))[count(*) // 2 + 1] AS median
FROM v_responses WHERE success AND latency IS NOT NULL GROUP BY day, system"""
