"""Question, paper, template and result files; payloads; the cache; user functions."""

import json

import pandas as pd
from pyspark.sql import functions as F

from qamill.sources import cache, documents, results


def dump(path, value):
    path.write_text(json.dumps(value))


def test_questions_from_list_or_object(spark, tmp_path):
    dump(tmp_path / "a.json", [{"question_id": "q1", "question": "A?", "gold_answer": {"text": "g"}}, {"question_id": "q2"}])
    dump(tmp_path / "b.json", {"question_id": "q3", "metadata": {"query_type": "factoid", "special_categories": ["temporal"]}})
    rows = results.read_questions(spark, str(tmp_path)).collect()
    assert {r["question_id"] for r in rows} == {"q1", "q2", "q3"}
    assert [r["question_id"] for r in results.read_questions(spark, str(tmp_path), only_gold=True).collect()] == ["q1"]


def test_papers_default_to_the_file_name(spark, tmp_path):
    dump(tmp_path / "p7.json", {"metadata": {"title": "T"}, "sections": [{"heading": "H", "content": "c"}]})
    papers = results.read_papers(spark, str(tmp_path))
    assert papers.first()["paper_id"] == "p7"
    asked = spark.createDataFrame([("q", "p7"), ("r", "none")], "question_id string, paper_id string")
    assert [r["question_id"] for r in results.with_paper(asked, papers).collect()] == ["q"]


def test_templates(spark, tmp_path):
    (tmp_path / "factoid.txt").write_text("What is {x}?\n\n  Who is {y}? \n")
    rows = results.read_templates(spark, str(tmp_path)).orderBy("template_ix").collect()
    assert [(r["query_type"], r["template_ix"], r["template"]) for r in rows] == [
        ("factoid", 0, "What is {x}?"), ("factoid", 1, "Who is {y}?")]


def test_last_evaluation_per_system(spark, tmp_path):
    response = lambda ok, at: {"success": ok, "latency": 1.5, "timestamp": at, "question": {"question_id": "q"}}
    dump(tmp_path / "old.json", {"system": {"name": "s"}, "timestamp": "2024-01-01T00:00:00", "responses": [response(True, "2024-01-01T00:00:00")] * 3})
    dump(tmp_path / "new.json", {"system": {"name": "s"}, "timestamp": "2024-02-01T00:00:00", "responses": [response(True, "2024-02-01T10:00:00"), response(False, "1704103200.5")]})
    rows = results.read_evaluations(spark, str(tmp_path)).orderBy("question_ix").collect()
    assert [r["question_ix"] for r in rows] == [0, 1] and [r["success"] for r in rows] == [True, False]
    assert str(rows[0]["ts"]) == "2024-02-01 10:00:00" and str(rows[1]["ts"]) == "2024-01-01 10:00:00.500000"


def test_payload_rules(spark):
    raw = ['{"answer": "a", "text": "t", "contexts": [{"id": "1", "text": "x"}]}', '{"text": "t", "context": {"id": "2"}}',
           '{"result": "r"}', '{"other": 1}', None]
    df = spark.createDataFrame([(i, r, i != 4, 2.0, "bad" if i == 4 else None) for i, r in enumerate(raw)],
                               "i int, raw string, success boolean, latency double, error string")
    got = results.normalise_responses(df).orderBy("i").collect()
    assert [r["answer"] for r in got] == ["a", "t", "r", '{"other": 1}', None]
    assert [None if r["contexts"] is None else [c["id"] for c in r["contexts"]] for r in got] == [["1"], ["2"], None, None, None]
    assert got[4]["latency"] == 0.0 and got[4]["error"] == "bad"


def test_ask_runs_a_user_function(spark):
    def answer(batches):
        for batch in batches:
            yield pd.DataFrame({"question": batch["question"], "answer": batch["question"].str.upper(), "success": True})

    asked = spark.createDataFrame([("a",), ("b",)], "question string")
    got = results.ask(asked, answer, "question string, answer string, success boolean", parallel=3)
    assert {(r["question"], r["answer"]) for r in got.collect()} == {("a", "A"), ("b", "B")}


def test_cache(spark):
    rows = [("s", "q1", "old", "2024-01-01 00:00:00", True), ("s", "q1", "new", "2024-01-02 00:00:00", True),
            ("s", "q2", "x", "2024-01-01 00:00:00", True), ("s", "q3", "x", "2024-01-02 00:00:00", False)]
    log = spark.createDataFrame(rows, "system string, question string, answer string, ts string, success boolean").withColumn("ts", F.to_timestamp("ts"))
    asked = spark.createDataFrame([("s", "q1"), ("s", "q2"), ("s", "q3"), ("t", "q1")], "system string, question string")
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    found = cache.lookup(asked, cache.cacheable(log), now)
    got = {(r["system"], r["question"]): (r["hit"], r["cached_answer"]) for r in found.collect()}
    assert got == {("s", "q1"): (True, "new"), ("s", "q2"): (False, None), ("s", "q3"): (False, None), ("t", "q1"): (False, None)}
    assert cache.misses(found).count() == 3
    forever = cache.lookup(asked, cache.cacheable(log), now, ttl_seconds=0)
    assert forever.where("hit").count() == 2


def test_database_scan_options(spark, monkeypatch):
    """No database is started: the options handed to the reader are checked."""
    seen = {}

    class Reader:
        def option(self, key, value):
            seen[key] = value
            return self

        def options(self, **kw):
            seen.update(kw)
            return self

        def load(self):
            return spark.range(5)

    class Session:
        @property
        def read(self):
            outer = self
            del outer
            return type("R", (), {"format": lambda self, kind: Reader()})()

    assert documents.scan_database(Session(), "jdbc:x", "select 1", limit=2).count() == 2
    assert seen["query"] == "select 1"
    seen.clear()
    documents.scan_database(Session(), "jdbc:x", "select 1", partition=("id", 0, 100, 4))
    assert seen["numPartitions"] == 4 and "query" not in seen and seen["dbtable"].startswith("(select 1)")
