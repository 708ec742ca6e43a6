"""Chunks, splits, pages, document scans and sinks."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from qamill.operators import corpus as co
from qamill.plans import corpus_build
from qamill.sources import documents, sinks

T = F.col("t")


def test_char_chunks_keep_the_tail_inside(one):
    assert one(co.char_chunks(T, 5, 2), t="abcdefghij") == ["abcde", "defgh", "ghij", "j"]
    assert one(co.char_chunks(T, 5, 2), t="") == []
    with pytest.raises(ValueError):
        co.char_chunks(T, 5, 5)


@settings(max_examples=10, deadline=None)
@given(st.text(alphabet="aé😀 .", min_size=1, max_size=50), st.integers(2, 9), st.data())
def test_chunks_cover_every_character(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spark = SparkSession.getActiveSession()
    got = spark.createDataFrame([(text,)], "t string").select(co.char_chunks(T, size, overlap).alias("x")).first()["x"]
    assert got == [text[i:i + size] for i in range(0, len(text), size - overlap)]


def pack(sentences, size, overlap):
    chunks, cur, total = [], [], 0
    for s in sentences:
        if total + len(s) > size and cur:
            chunks.append(" ".join(cur))
            keep, n = [], 0
            for x in reversed(cur):
                if n + len(x) > overlap:
                    break
                keep.insert(0, x)
                n += len(x)
            cur, total = keep, n
        cur.append(s)
        total += len(s)
    return chunks + ([" ".join(cur)] if cur else [])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=14), st.integers(5, 30), st.integers(0, 15))
def test_sentence_chunks_match_a_plain_fold(lengths, size, overlap):
    sentences = ["x" * n + "." for n in lengths]
    spark = SparkSession.getActiveSession()
    got = spark.createDataFrame([(" ".join(sentences),)], "t string").select(
        co.sentence_chunks(T, size, overlap).alias("x")).first()["x"]
    assert got == pack(sentences, size, overlap)


def test_html_text(one):
    page = ("<html><head><title>t</title></head><body><script>var t='</p>';</script><!-- x --><h1>A &amp; B</h1>"
            "<p>one<b>two</b></p><ul><li>a &lt; b</li></ul></body></html>")
    assert one(co.html_text(T), t=page) == "A & B\nonetwo\na < b"


def test_routes(one):
    for name, want in [("a.TXT", "text"), ("a.htm", "html"), ("a.docx", "word"), ("a.csv", "structured"),
                       ("a.json", "data"), ("a.pdf", "pdf"), ("a.exe", None), ("a", None)]:
        assert one(co.route(T), t=name) == want


def test_splits_are_disjoint_complete_and_exact(spark):
    rows = [(f"d{i}", "hot" if i % 3 else None) for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id string, lang string")
    got = co.assign_splits(df, stratum="lang").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    for level in ("hot", None):
        n = sum(1 for r in rows if r[1] == level)
        train = sum(1 for r in got if r["lang"] == level and r["split"] == "train")
        val = sum(1 for r in got if r["lang"] == level and r["split"] == "val")
        assert train == int(n * 0.7) and val == int((n - train) * 0.5)
    assert co.normalise_ratios(7, 1.5, 1.5) == (0.7, 0.15, 0.15)
    assert co.normalise_ratios(0.7, 0.15, 0.15) == (0.7, 0.15, 0.15)


def test_scan_decode_and_write(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("Hello  there.")
    (tmp_path / "in" / "sub" / "b.html").write_text("<p>page</p>")
    (tmp_path / "in" / "c.exe").write_text("no")
    files = documents.scan_documents(spark, str(tmp_path / "in"))
    assert files.count() == 3
    assert documents.scan_documents(spark, str(tmp_path / "in"), ["txt"]).count() == 1
    assert documents.scan_documents(spark, str(tmp_path / "in"), exclude="sub/").count() == 2
    docs = documents.decode_documents(files)
    assert {r["original_filename"]: r["text"] for r in docs.collect()} == {"a.txt": "Hello  there.", "b.html": "page"}
    assert all(len(r["doc_id"]) == 12 for r in docs.collect())
    corpus_build.write(docs.select("doc_id", "text"), str(tmp_path / "out"))
    members = spark.read.parquet(str(tmp_path / "out" / "members"))
    assert {r["text"] for r in members.collect()} == {"Hello there.", "page"}


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,x\n2,y\n")
    rows = documents.structured_records(spark, str(tmp_path / "r.csv"), "a int, b string").collect()
    assert [r["text"] for r in rows] == ['{"a":1,"b":"x"}', '{"a":2,"b":"y"}']


def test_incremental_append(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = lambda *ids: spark.createDataFrame([(i, f"v{n}") for n, i in enumerate(ids)], "id int, v string")
    sinks.append_new(rows(1, 2), path, ["id"])
    sinks.append_new(rows(2, 3), path, ["id"])
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "v0"), (2, "v1"), (3, "v1")]
    sinks.append_new(rows(9), path, ["id"], overwrite_existing=True)
    assert spark.read.parquet(path).count() == 1
    sinks.write_csv(spark.createDataFrame([('a "b"\nc',)], "t string"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first()["t"] == 'a "b"\nc'
