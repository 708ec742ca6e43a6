"""Mixing, sharding and the link graph: the operators without Python in their tasks."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import messy, nothing, rows_of  # noqa: F401

from qamill.llm import linkgraph, mixing, sharding


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def targets(sizes):
    """Shares by weight, stopped at three times the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def check_mix(docs):
    rows = rows_of(mixing.mix_documents(docs))
    given = rows_of(docs.select("doc_id", "text", "source"))
    words = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((g["doc_id"], words(g["text"])) for g in given)
    sizes = defaultdict(int)
    for g in given:
        sizes[g["source"]] += words(g["text"])
    want = targets(sizes)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by_pair = defaultdict(int)
    for r in rows:
        by_pair[r["source_size"], round(r["target"], 6)] += r["taken"]
    expected = defaultdict(float)
    for s in sizes:
        expected[sizes[s], round(want[s], 6)] += want[s]
    assert by_pair.keys() == expected.keys()
    assert all(abs(by_pair[p] - expected[p]) <= 0.51 * len(sizes) for p in by_pair)
    return rows


def test_mix_of_messy_rows(messy):
    check_mix(messy)


def test_mix_of_nothing(nothing):
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.mixture(nothing).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 3, "c": 1}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 900, None: 50}, {"a": 0, "b": 0}])
def test_targets_stop_at_three_times_the_size(spark, sizes):
    rows = [(i * 1000 + j, "w " * 7 if n >= 7 else "w " * n, s) for i, (s, n) in enumerate(sizes.items())
            for j in range(max(1, n // 7))]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_is_native_and_repeats(messy, spark):
    df = mixing.mix_documents(messy)
    first = sorted(map(str, rows_of(df)))
    assert python_free(df)
    again = sorted(map(str, rows_of(mixing.mix_documents(messy.repartition(7)))))
    assert first == again


def test_mixture_holds_what_was_taken(messy):
    docs = messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix_documents(docs))}
    found, shards = Counter(), set()
    for row in rows_of(mixing.mixture(docs)):
        found[row["doc_id"]] += len(row["text"].encode().split())
        shards.add(row["shard"])
    assert {d: n for d, n in taken.items() if n} == dict(found)
    assert shards <= set(range(8))


def test_every_shard_gets_its_share(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    rows = rows_of(mixing.mixture(docs))
    per = Counter(r["shard"] for r in rows)
    assert len(per) == 8 and max(per.values()) < 1.35 * min(per.values())
    share = Counter((r["shard"], r["source"]) for r in rows)
    of_a = [share[s, "a"] / per[s] for s in range(8)]
    assert max(of_a) - min(of_a) < 0.15


def check_shards(docs):
    rows = rows_of(sharding.shard_documents(docs))
    given = rows_of(docs.select("doc_id", "text"))
    want = Counter((g["doc_id"], len((g["text"] or "").encode()) + 1, zlib.crc32((g["text"] or "").encode())) for g in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(8)]
    assert set(slots) <= set(range(8)) and max(counts) - min(counts) <= 1
    return rows


def test_shards_of_messy_rows(messy, nothing):
    check_shards(messy)
    assert check_shards(nothing) == []


def test_one_row_repeated_is_scattered(spark):
    docs = spark.range(3000).selectExpr("IF(id < 2000, 1, id) AS doc_id", "'same' AS text")
    check_shards(docs)
    rows = docs.selectExpr("doc_id", "CAST(5 AS LONG) AS size", "CAST(1 AS LONG) AS text_crc32")
    found = rows_of(sharding.external_shuffle(rows, bucket_rows=200))
    ones = Counter(r["slot"] // 75 for r in found if r["doc_id"] == 1)
    assert len(found) == 3000 and len(ones) == 5 and max(ones.values()) < 600


def test_shards_do_not_depend_on_partitions(messy, spark):
    first = sorted(map(str, rows_of(sharding.shard_documents(messy))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = sorted(map(str, rows_of(sharding.shard_documents(messy.repartition(5)))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again


def test_written_shards_hold_all_rows(messy, spark, tmp_path):
    docs = messy.select("doc_id", "text", "source")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(back)) == Counter((r["doc_id"], r["text"]) for r in rows_of(docs))


def test_texts_go_through_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "ab" * (i % 7), "x") for i in range(50)] + [(None, None, None)], "doc_id long, text string, source string")
    placed = sharding.shuffled_documents(docs)
    assert Counter(tuple(r["doc"]) for r in placed.collect()) == Counter(map(tuple, docs.collect()))
    # the query's own plan carries them too: what it collects in a bucket is the whole row
    plan = sharding.shard_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(_h, xxhash64(doc" in plan
    check_shards(docs)


PAGES = "page_id long, url string, html string, host string, rule string"


def page(i, url, html=""):
    return (i, url, html, "x", "y")


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.ORG/x?y#z", "a.example.org", "/x", "org/", "allow"),
        ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("https://www.example.org/en/17", "www.example.org", "/en/17", "example.org/en/1", "block"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com#/fr/", "x.com", "", None, "allow"), ("http://org", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("x://y://z/p", "y:", "//z/p", None, "allow"), ("http://h?q=/de/", "h", "", None, "allow"),
        ("http://ÄB.com/de/", "Äb.com", "/de/", "com/de/", "block")]
    pages = spark.createDataFrame([page(i, c[0]) for i, c in enumerate(cases)], PAGES)
    rows = {r["page_id"]: r for r in rows_of(linkgraph.judge_pages(pages))}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, verdict), cases[i]


def ranks(seeds, edges, damping, rounds):
    hosts = sorted(set(seeds) | {h for e in edges for h in e[:2]})
    at = {h: i for i, h in enumerate(hosts)}
    out = []
    for which in (0, 1):
        moves = np.zeros((len(hosts), len(hosts)))
        for a, b, n in edges:
            a, b = (a, b) if which == 0 else (b, a)
            moves[at[b], at[a]] += n
        total = moves.sum(axis=0)
        moves = np.divide(moves, total, out=np.zeros_like(moves), where=total > 0)
        base = np.array([seeds.get(h, (0, 0))[which] for h in hosts]) * (1 - damping)
        state = base.copy()
        for _ in range(rounds):
            state = base + damping * moves @ state
        out.append(state)
    return {h: (out[0][i], out[1][i]) for h, i in at.items()}


def test_propagation_equals_a_matrix(spark):
    rng = np.random.default_rng(3)
    names = [f"h{i}" for i in range(15)]
    edges = [(names[a], names[b], int(n)) for a, b, n in zip(rng.integers(0, 15, 50), rng.integers(0, 15, 50), rng.integers(1, 5, 50)) if a != b]
    edges = [(a, b, n) for (a, b), n in {(a, b): n for a, b, n in edges}.items()]
    seeds = {"h0": (4.0, 0.0), "h1": (0.0, 3.0), "h2": (1.0, 1.0)}
    got = linkgraph.propagate(
        spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"),
        spark.createDataFrame(edges, "src string, dst string, links long"), rounds=6, settled=0.0)
    want = ranks(seeds, edges, 0.85, 6)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows_of(got)}
    for host, pair in want.items():
        assert np.allclose(got.get(host, (0.0, 0.0)), pair)


def test_distrust_flows_back_to_hosts_that_link_to_blocked_ones(spark):
    bad = [page(i, f"http://bad.com/de/{i}") for i in range(30)]
    friend = [page(100, "http://friend.net/a", '<a HREF="HTTPS://BAD.com/x">'), page(101, "http://friend.net/b", "<a href='//bad.com'>")]
    good = [page(200 + i, f"http://good.org/{i}", "<a href='http://far.net/1'> <a href='/local'>") for i in range(30)]
    far = [page(300, "http://far.net/1", None), page(301, "http://lonely.net/")]
    pages = spark.createDataFrame(bad + friend + good + far, PAGES)
    df = linkgraph.judge_pages(pages)
    assert python_free(df)
    verdict = {r["page_id"]: r["verdict"] for r in rows_of(df)}
    assert verdict[100] == verdict[101] == "block"
    assert verdict[300] == verdict[301] == verdict[200] == "allow"


def test_no_pages(spark):
    assert linkgraph.judge_pages(spark.createDataFrame([], PAGES)).count() == 0
