"""The pipeline: stage by stage on the small tables, and on messy rows."""

from collections import Counter

import pytest
from llm_cases import messy, nothing, rows_of  # noqa: F401
from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from qamill.llm import jaccard, registry, secrets
from qamill.session import materialise

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), "stage")
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_stages_take_effect(stages, spark):
    raw, good, unique, clean, mixed, encoded = (rows_of(s) for s in stages)
    assert len(raw) > len(good) > len(unique) == len(clean)
    again = rows_of(jaccard.join(stages[2]))
    assert all(r["doc_id"] == r["component_id"] for r in again)
    assert {r["doc_id"] for r in unique} <= {r["doc_id"] for r in good}
    assert not any(secrets.base_spans(r["text"]) for r in clean)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == want


def test_messy_rows_go_through(spark, messy, nothing, tmp_path):
    for docs in (messy, nothing.select("*")):
        folder = str(tmp_path / str(docs.count()))
        docs.write.parquet(f"{folder}/documents.parquet")
        docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{folder}/labels.parquet")
        rows = rows_of(registry.queries()["pipeline"](spark, folder))
        assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in rows)
        assert bool(rows) == (docs is messy)


def test_no_text_is_lost_with_its_id(spark):
    a, b, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60)), " ".join(f"a{i}" for i in range(59))
    rows = [(1, a), (1, b), (2, a), (None, a), (None, near), (None, b), (None, "own words only"), (5, "own words only too"),
            (5, "own words only too"), (7, None), (7, ""), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', 1) AS m", "'x' AS component_id", "'y' AS first")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, "own words only"), (5, "own words only too"), (7, None), (7, ""), (8, " ")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_broadcast_no_copies_of_components(spark):
    """Spark sizes the CELLS copies of a component as one; the stage must not broadcast them."""
    rows = [(i, f"word{i % 7} " * 3 + "the of and to in", "en", "a", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in rows_of(out)) == list(range(7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_s#" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "_s#" in line]
