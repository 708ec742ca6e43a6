"""Streams against their batch twins."""

from datetime import datetime

from pyspark.sql import functions as F

from qamill.streaming import expiry
from qamill.streaming import responses as st

KIND = "system string, question string, success boolean, latency double, ts timestamp"


def rows(spark, items):
    return spark.createDataFrame(items, "system string, question string, success boolean, latency double, at string").select(
        "system", "question", "success", "latency", F.to_timestamp("at").alias("ts"))


def stream_of(spark, path, *files):
    for n, items in enumerate(files):
        rows(spark, items).coalesce(1).write.parquet(f"{path}/f{n}")
    return (spark.readStream.schema(KIND).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .option("maxFilesPerTrigger", 1).parquet(str(path)))


LOG = [("a", "q1", True, 1.0, "2024-01-01 01:00:00"), ("a", "q1", True, 3.0, "2024-01-01 02:00:00"),
       ("a", "q2", False, 9.0, "2024-01-01 03:00:00"), ("b", "q1", True, 2.0, "2024-01-02 01:00:00")]
MORE = [("a", "q1", True, 5.0, "2024-01-01 23:30:00"), ("b", "q3", False, 1.0, "2024-01-02 02:00:00")]


def test_window_summary_equals_batch(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", LOG, MORE)
    got = st.run_update(st.window_summary(stream, delay="2 days"), "t-window", ["window_start", "system"])
    want = st.window_summary_batch(rows(spark, LOG + MORE))
    order = ["window_start", "system"]
    assert got.select(*want.columns).orderBy(*order).collect() == want.orderBy(*order).collect()


def test_first_requests_equal_batch(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", LOG, MORE)
    got = st.run_append(st.first_requests(stream, "10 days"), "t-first").select("system", "question").collect()
    assert sorted(map(tuple, got)) == sorted({(r[0], r[1]) for r in LOG + MORE})


def test_a_key_returns_after_its_ttl(spark, tmp_path):
    late = [("a", "q1", True, 1.0, "2024-01-09 00:00:00")]
    later = [("a", "q1", True, 1.0, "2024-01-20 00:00:00")]
    last = [("a", "q1", True, 1.0, "2024-02-20 00:00:00")]
    # a key is held for at least the ttl: it leaves at the end of a batch past it
    stream = stream_of(spark, tmp_path / "in", LOG, late, later, last)
    got = st.run_append(st.first_requests(stream, "1 day"), "t-ttl").where("system = 'a' AND question = 'q1'")
    assert got.count() >= 2


def answered_in_batch(items, ttl_seconds):
    """Every key's requests, sorted and folded in plain Python."""
    stored, out = {}, []
    micros = lambda text: int(datetime.fromisoformat(text + "+00:00").timestamp() * 1_000_000)
    for system, question, success, _, at in sorted((r for r in items if r[0] and r[1]), key=lambda r: (r[4], not r[2])):
        last = stored.get((system, question))
        hit = last is not None and (ttl_seconds <= 0 or micros(at) - last <= ttl_seconds * 1_000_000)
        if not hit and success:
            stored[system, question] = micros(at)
        out.append((system, question, at, success, hit))
    return sorted(out)


def answered(df):
    return sorted((r["system"], r["question"], str(r["ts"]), r["success"], r["hit"]) for r in df.collect())


def test_entries_expire_on_the_stream_as_in_the_batch(spark, tmp_path):
    log = [("a", "q", False, 1.0, "2024-01-01 00:00:00"), ("a", "q", True, 1.0, "2024-01-01 10:00:00"),
           ("a", "q", True, 1.0, "2024-01-02 09:00:00"), ("a", "q", False, 1.0, "2024-01-02 10:00:00"), (None, "q", True, 1.0, "2024-01-01 00:00:00")]
    # the second file brings requests from before the first file's last ones
    more = [("a", "q", True, 1.0, "2024-01-02 10:00:01"), ("a", "q", True, 1.0, "2024-01-01 23:00:00"), ("b", "q", True, 2.0, "2024-01-02 12:00:00"),
            ("b", "q", True, 2.0, "2024-01-02 12:00:00")]
    last = [("z", "z", True, 1.0, "2024-03-01 00:00:00")]
    stream = stream_of(spark, tmp_path / "in", log, more, last)
    with expiry.rocks_state(spark):
        got = answered(st.run_append(expiry.cache_hits(stream, 86400, "2 days"), "t-expiry").where("system <> 'z'"))
    want = answered_in_batch(log + more, 86400)
    assert got == want
    hits = {r[2]: r[4] for r in got if r[0] == "a"}
    assert hits == {"2024-01-01 00:00:00": False, "2024-01-01 10:00:00": False, "2024-01-01 23:00:00": True,
                    "2024-01-02 09:00:00": True, "2024-01-02 10:00:00": True, "2024-01-02 10:00:01": False}
    assert sorted(r[4] for r in got if r[0] == "b") == [False, True]


def test_no_expiry():
    requests = [(0, "a", "q", False), (1, "a", "q", True), (10**18, "a", "q", False)]
    assert expiry.fold(None, requests, 0) == (1, [False, False, True])
    assert expiry.fold(None, requests, 10**18 - 2) == (1, [False, False, False])
    assert expiry.fold(5, [], 1) == (5, [])


def test_median_per_window_is_the_upper_one(spark, tmp_path):
    log = [("a", "q", True, float(x), f"2024-01-01 0{i}:00:00") for i, x in enumerate([5, 1, 1, 9])]
    more = [("a", "q", True, 7.0, "2024-01-02 00:00:00"), ("a", "q", False, 99.0, "2024-01-02 01:00:00"), ("b", "q", False, 1.0, "2024-01-02 01:00:00")]
    counts = st.run_update(st.latency_counts(stream_of(spark, tmp_path / "in", log, more), delay="2 days"), "t-median", ["window_start", "system", "latency"])
    got = sorted(tuple(r)[1:] for r in st.latency_quantiles(counts).collect())
    assert got == [("a", 1, 7.0, 7.0, 7.0, 7.0), ("a", 4, 4.0, 1.0, 9.0, 5.0)]
