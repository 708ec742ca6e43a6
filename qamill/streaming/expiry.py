"""ST1: the response cache on a stream, with entries that expire.

A request is a hit while the stored success of its key is at most ``ttl`` old; a miss is answered, and
stored if the answer is a success. State is one stored time per key and the requests that wait for the
watermark, so requests count in the order of their own times, not of their arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from qamill.sources.cache import cache_key

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "micros long, system string, question string, success boolean"
ANSWERED = "cache_key string, system string, question string, ts_micros long, success boolean, hit boolean"


def fold(stored: int | None, requests: list[tuple], ttl: int) -> tuple[int | None, list[bool]]:
    """(time stored at last, whether each request is a hit) of one key's requests in order.

    A request is (time in microseconds, system, question, success); ``ttl`` 0 or less never expires.
    """
    hits = []
    for micros, _, _, success in requests:
        hit = stored is not None and (ttl <= 0 or micros - stored <= ttl)
        if not hit and success:
            stored = micros
        hits.append(hit)
    return stored, hits


def ordered(requests: list[tuple]) -> list[tuple]:
    """By time; at the same time successes first, so that equal rows can stand in any order."""
    return sorted(requests, key=lambda r: (r[0], not r[3], r[1], r[2]))


class Requests(StatefulProcessor):
    """Holds a key's requests until the watermark has passed them, then answers them in order."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "micros long")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.micros), r.system, r.question, bool(r.success)) for part in rows for r in part.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        rows = ordered([tuple(r) for r in self.waiting.get()])
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if not due:
            return
        before = self.stored.get()[0] if self.stored.exists() else None
        after, hits = fold(before, due, self.ttl)
        if after is not None and after != before:
            self.stored.update((after,))
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame({
            "cache_key": [key[0]] * len(due), "system": [r[1] for r in due], "question": [r[2] for r in due],
            "ts_micros": [r[0] for r in due], "success": [r[3] for r in due], "hit": hits})

    def _wake(self, micros: int) -> None:
        # a timer goes off once the watermark is past it, and this one is due when it is reached
        self.handle.registerTimer(micros // 1000 - 1)

    def close(self) -> None:
        pass


def cache_hits(stream: DataFrame, ttl_seconds: int = 86400, delay: str = "0 seconds", time: str = "ts") -> DataFrame:
    """ST1: every request (system, question, success, time) with ``hit``, once the watermark has passed it.

    Requests later than ``delay`` are dropped by the watermark. Needs the RocksDB state store, see
    ``rocks_state``. Requests without system, question or time have no key and are left out; a null
    success counts as a failure.
    """
    keyed = stream.withColumn("cache_key", cache_key(F.col("system"), F.col("question"))).where(F.col("cache_key").isNotNull() & F.col(time).isNotNull())
    rows = keyed.withWatermark(time, delay).select(
        "cache_key", F.unix_micros(time).alias("micros"), "system", "question", F.coalesce("success", F.lit(False)).alias("success"), time)
    out = rows.groupBy("cache_key").transformWithStateInPandas(
        Requests(int(ttl_seconds * 1_000_000)), ANSWERED, "Append", "eventTime")
    return out.select("cache_key", "system", "question", F.timestamp_micros("ts_micros").alias("ts"), "success", "hit")


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers and list state need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
