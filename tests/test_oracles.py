"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest
from conftest import SMALL
from oracle_compare import compare, duck

from qamill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


# Queries without SQL, and the tests that check their rows instead.
WITHOUT_SQL = {
    "anova_p": "test_bias: published p values", "disparity": "test_bias", "vulnerable_categories": "test_adversarial",
    "word_lines": "test_papers", "concept_examples": "test_papers", "definitions": "test_questions",
    "comparisons": "test_questions", "fill_templates": "test_questions", "generate_questions": "test_questions",
    "question_set_report": "test_questions", "rouge_l": "test_metrics", "answer_metrics": "test_metrics",
    "evaluate_systems": "test_metrics", "evaluate_summary": "test_metrics",
}


def test_a_query_without_sql_is_listed():
    assert set(QUERIES) - set(SQL) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_gives_rows(spark, name):
    rows = QUERIES[name](spark, SMALL).limit(1).count()
    assert rows == (0 if name == "disparity" else 1)  # no difference is significant in the small tables


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SMALL, name, QUERIES[name], SQL.get(name))
    assert ok, message


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 13
