"""The entry module and the measured faults of earlier rounds."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from qamill.functions import stats
from qamill.functions import text as tx
from qamill.sources import results

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_needs_no_session():
    code = ("import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()); "
            "assert SparkSession.getActiveSession() is None")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_stands_without_the_training_operators(tmp_path):
    os.mkdir(tmp_path / "qamill")
    for name in os.listdir(f"{ROOT}/qamill"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/qamill/{name}", tmp_path / "qamill" / name)
    with open(f"{ROOT}/__spark_entry__.py") as file:
        (tmp_path / "__spark_entry__.py").write_text(file.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_stands_without_a_module_the_training_operators_need():
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; "
            "q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "public_tokenizers" in done.stderr, done.stderr


def test_nothing_else_imports_the_training_operators():
    for folder, _, names in os.walk(f"{ROOT}/qamill"):
        if "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    assert "qamill.llm" not in open(f"{folder}/{name}").read(), name


def test_spans_are_linear(spark):
    text = "Ab cd " * 32_000
    df = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    found = df.select(tx.spans(F.col("t"), "[A-Z][a-z]").alias("s")).select(F.size("s").alias("n"), F.col("s")[31_999].alias("last")).first()
    assert time.time() - start < 10
    assert found["n"] == 32_000 and tuple(found["last"]) == ("Ab", 6 * 31_999, 6 * 31_999 + 2)


@pytest.mark.parametrize("pieces", [0, 1, 2, 255, 256, 257, 511, 513])
def test_spans_at_the_borders_of_runs(spark, pieces):
    text = "".join(f"x{'Q' * (i % 3 + 1)}" for i in range(pieces)) + "x"
    df = spark.createDataFrame([(text,)], "t string")
    got = [tuple(s) for s in df.select(tx.spans(F.col("t"), "Q+").alias("s")).first()["s"]]
    import re
    assert got == [(m[0], m.start(), m.end()) for m in re.finditer("Q+", text)]


@pytest.mark.parametrize("d2", [1e9, 1e12, 1e13, 1e14])
def test_tail_of_many_rows_meets_its_limit(d2):
    assert stats.f_tail(1.2, 6.0, d2) == pytest.approx(0.302747, abs=2e-6)


def test_last_evaluation_by_time_not_by_text(spark, tmp_path):
    def write(name, stamp):
        body = {"system": {"name": "s"}, "timestamp": stamp, "responses": [{"question": {"question_id": name}, "success": True}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(body))

    write("old", "2023-05-01T00:00:00")
    write("new", "1735689600")  # seconds, 2025
    rows = results.read_evaluations(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and "new" in rows[0]["eval_id"]
