"""Runs that commit: nothing of a killed run is seen, retries change nothing, no text comes twice."""

import os

import pytest
from pyspark.sql import functions as F
from test_assignment import ONE, papers

from qamill.operators import questions as qu
from qamill.plans import question_set
from qamill.sources import increments as inc


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, v string")


def all_of(spark, path):
    return sorted((tuple(r) for r in inc.read_runs(spark, path).collect()), key=str)


def test_runs_add_up(spark, tmp_path):
    path = str(tmp_path / "t")
    assert inc.committed(spark, path) == (0, []) and inc.read_runs(spark, path) is None
    assert inc.append(rows(spark, (1, "a"), (None, "b"), (1, "c")), path, ["id"], "one")
    assert inc.append(rows(spark, (1, "x"), (None, "y"), (2, "z")), path, ["id"], "two")
    assert all_of(spark, path) == sorted([(1, "a"), (1, "c"), (None, "b"), (2, "z")], key=str)
    assert not inc.append(rows(spark, (7, "again")), path, ["id"], "two")
    assert inc.append(rows(spark).limit(0), path, ["id"], "empty")
    assert inc.committed(spark, path) == (3, ["one", "two", "empty"])
    assert inc.append(rows(spark, (1, "new")).withColumn("extra", F.lit(5)), path, ["id"], "all", replace=True)
    assert all_of(spark, path) == [(1, "new", 5)]
    with pytest.raises(ValueError):
        inc.append(rows(spark, (1, "a")).withColumn("_part", F.lit(1)), path, ["id"], "clash")


def test_an_empty_run_comes_first(spark, tmp_path):
    path = str(tmp_path / "t")
    inc.append(rows(spark, (1, "a")).limit(0), path, ["id"], "none")
    assert all_of(spark, path) == [] and inc.append(rows(spark, (1, "a")), path, ["id"], "one")
    assert all_of(spark, path) == [(1, "a")]


def test_a_killed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    inc.append(rows(spark, (1, "a")), path, ["id"], "one")
    # in the middle of the rows: some partitions are written, one fails
    broken = spark.range(100, 200, 1, 10).select(F.col("id").cast("int").alias("id"), F.when(
        F.col("id") == 195, F.raise_error(F.lit("lost"))).otherwise("v").cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        inc.append(broken, path, ["id"], "two")
    assert all_of(spark, path) == [(1, "a")]
    # after the rows, before the commit
    with monkeypatch.context() as m:
        m.setattr(inc, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            inc.append(rows(spark, (2, "b"), (3, "b")), path, ["id"], "two")
    assert os.path.exists(inc._data(path, "two")) and all_of(spark, path) == [(1, "a")]
    assert inc.append(rows(spark, (2, "c")), path, ["id"], "two")
    assert all_of(spark, path) == [(1, "a"), (2, "c")]


def test_two_runs_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commit = inc._commit

    def late(spark_, path_, number, runs):
        with monkeypatch.context() as m:
            m.setattr(inc, "_commit", commit)
            inc.append(rows(spark, (1, "first")), path, ["id"], "other")
        commit(spark_, path_, number, runs)

    with monkeypatch.context() as m:
        m.setattr(inc, "_commit", late)
        with pytest.raises(inc.CommitConflict):
            inc.append(rows(spark, (1, "second"), (2, "second")), path, ["id"], "mine")
    assert all_of(spark, path) == [(1, "first")]
    assert inc.append(rows(spark, (1, "second"), (2, "second")), path, ["id"], "mine")
    assert all_of(spark, path) == [(1, "first"), (2, "second")]


def test_only_touched_parts_of_the_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    inc.append(spark.range(5000).selectExpr("cast(id AS int) AS id", "'v' AS v"), path, ["id"], "one")
    found = inc.unseen(rows(spark, (17, "x"), (70_000, "y")), path, ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part#" in plan and [r["id"] for r in found.collect()] == [70_000]


def test_texts_of_earlier_runs_are_not_asked_again(spark):
    made = papers(spark, {"a": ["x", "y"], "b": ["x", "z"]})
    taken = spark.createDataFrame([("What is meant by x?",), ("What is meant by x?",), (None,)], "question string")
    got = {(r["paper_id"], r["question"]) for r in qu.generate(made, 2, ONE, taken=taken).collect()}
    assert got == {("a", "What is meant by y?"), ("b", "What is meant by z?")}


def test_question_set_grows_by_runs(spark, tmp_path):
    text = lambda k: ("A Study\n\nAbstract\nWe study things.\n\n1. Introduction\nThe Neural Network is good. A Neural Network works. "
                      f"The Deep Tree{k} is used. Deep Tree{k} helps. Deep Tree{k} wins.\n")
    texts = lambda *names: spark.createDataFrame([(n, text(n[-1])) for n in names], "paper_id string, full_text string")
    path = str(tmp_path / "set")
    assert question_set.extend(texts("p1"), path, "monday", n=3)
    assert question_set.extend(texts("p1", "p2"), path, "tuesday", n=3)
    assert not question_set.extend(texts("p1", "p2"), path, "tuesday", n=3)
    asked = [r["question"] for r in inc.read_runs(spark, f"{path}/questions").select("question").collect()]
    assert len(asked) == len(set(asked)) and len(asked) >= 4
    assert sorted(r["paper_id"] for r in inc.read_runs(spark, f"{path}/papers").collect()) == ["p1", "p2"]
