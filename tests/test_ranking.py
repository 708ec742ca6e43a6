"""Exact ranks and quantiles, also with one hot group."""

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from qamill.operators.ranking import exact_quantile, hashed_rank


def test_hashed_rank_is_the_plain_rank(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(600)] + [(None, 1000), (None, 1001)]
    df = spark.createDataFrame(rows, "k string, id long").withColumn("p", F.md5(F.col("id").cast("string")))
    got = {(r["k"], r["id"]): (r["rank_ix"], r["group_size"]) for r in hashed_rank(df, ["k"], "p", "id").collect()}
    groups = {}
    for k, i in rows:
        groups.setdefault(k, []).append(i)
    for k, ids in groups.items():
        ids.sort(key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        for n, i in enumerate(ids, 1):
            assert got[(k, i)] == (n, len(ids))


def test_exact_median_and_upper(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([rng.random(), 0.5, rng.gauss(0, 100)])) for _ in range(30001)]
    rows += [("pair", 1.0), ("pair", 3.0), ("one", 2.0)] + [("even", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, v double")
    mid = {r["k"]: r["m"] for r in exact_quantile(df, ["k"], "v", out="m").collect()}
    up = {r["k"]: r["m"] for r in exact_quantile(df, ["k"], "v", upper=True, out="m").collect()}
    for k in ("hot", "pair", "one", "even"):
        values = sorted(v for g, v in rows if g == k)
        assert abs(mid[k] - statistics.median(values)) < 1e-12
        assert up[k] == values[len(values) // 2]


def test_other_quantiles_with_a_coarse_sketch(spark):
    values = [float((i * 7919) % 5003) for i in range(5003)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.1, 0.5, 0.93, 1.0):
        got = exact_quantile(df, [], "v", q, accuracy=50, out="m").first()["m"]
        at = q * (len(values) - 1)
        want = sorted(values)
        lo = int(at)
        exact = want[lo] + (want[min(lo + 1, len(want) - 1)] - want[lo]) * (at - lo)
        assert abs(got - exact) < 1e-9
