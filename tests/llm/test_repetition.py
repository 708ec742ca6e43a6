import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import messy, nothing, rows_of  # noqa: F401
from pyspark.sql import functions as F

from qamill.llm import registry, repetition, transform


def plain_runs(words):
    """Every stretch with each period, compared word by word."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_digest(doc_id, text):
    words = text.split(" ") if text is not None else []
    words = [w for part in words for w in part.replace("\n", " ").replace("\t", " ").split(" ") if w]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), "collapsed_sha256": sha(kept)}


@pytest.mark.parametrize("size", [1, 2, 4, 32, 64, 256, 2048])
def test_distances_are_exact(size):
    rng = np.random.default_rng(size)
    top = max(2, int(((transform.prime_for(2 * size) - 1) // size) ** 0.5))
    blocks, windows = rng.integers(0, top, (3, size)).astype(float), rng.integers(0, top, (3, 2 * size)).astype(float)
    windows[0, 1:1 + size] = blocks[0] if size > 1 else windows[0, 1:2]
    expected = [[((b - w[o:o + size]) ** 2).sum() for o in range(size)] for b, w in zip(blocks, windows)]
    assert (transform.distances(blocks, windows) == np.array(expected)).all()


def test_long_transforms_use_the_large_prime(monkeypatch):
    monkeypatch.setattr(transform, "SHORT", 0)
    monkeypatch.setattr(transform, "prime_for", lambda size: transform.LONG)
    rng = np.random.default_rng(1)
    blocks, windows = rng.integers(0, 500, (2, 128)).astype(float), rng.integers(0, 500, (2, 256)).astype(float)
    expected = [[((b - w[o:o + 128]) ** 2).sum() for o in range(128)] for b, w in zip(blocks, windows)]
    assert (transform.distances(blocks, windows) == np.array(expected)).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 9)),
                         max_size=5), max_size=6))
def test_runs_equal_those_of_plain_search(texts):
    texts = [[w for part, times in text for w in part * times] for text in texts]
    assert repetition.runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_of_a_batch_do_not_cross_texts():
    rng = random.Random(3)
    texts = [[b"x"] * 4, [b"x"] * 4, [b"%d" % rng.randrange(9) for _ in range(300)], [], [b"y", b"z"] * 40 + [b"y"]]
    assert repetition.runs_of(texts) == [plain_runs(t) for t in texts]
    assert repetition.runs_of(texts)[4] == [(0, 81, 2)]


def test_long_texts_are_fast():
    began = time.time()
    assert repetition.runs_of([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert repetition.runs_of([[b"%d" % (i % 7777) for i in range(100_000)]]) == [[(0, 100_000, 7777)]]
    assert time.time() - began < 20


def test_query_equals_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in rows_of(registry.op11_periodic_runs(spark, "/root/testdata/sf0.001"))}
    short = [r for r in rows_of(docs.select("doc_id", "text")) if r["text"] is None or len(r["text"]) < 9000]
    assert len(got) == docs.count() and len(short) > 150
    for r in short:
        assert got[r["doc_id"]] == plain_digest(r["doc_id"], r["text"])
    assert any(r["n_runs"] for r in got.values())


def test_strange_rows(messy, nothing):  # noqa: F811
    rows = rows_of(repetition.run_digests(messy))
    assert len(rows) == messy.count()
    blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert all(r["n_runs"] == 0 and r["length"] is None and r["collapsed_sha256"] == hashlib.sha256(b"").hexdigest() for r in blank)
    assert len({str(r) for r in rows if r["doc_id"] == 9}) == 1
    assert repetition.run_digests(nothing).count() == 0
    assert repetition.find_runs(messy.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == len(rows)


def test_collapsed_text_keeps_one_period(spark):
    docs = spark.createDataFrame([("d", "so " + "a b c " * 6 + "end")], "doc_id string, text string")
    r = repetition.find_runs(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 18, 3)] and r["collapsed"] == "so a b c end"
