"""From the nested rows of the readers to the flat columns of the operators, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.operators import catalogue as cat

IN_METADATA = ["query_type", "complexity", "special_categories", "template", "template_slots", "is_seed", "adversarial", "validation"]
OF_PAPER = ["title", "authors", "abstract", "keywords"]
SHARES = {"query_type": cat.TYPE_SHARES, "complexity": cat.LEVEL_SHARES, "special_category": cat.SPECIAL_SHARES}
MOST_TEMPLATES = 100_000


def flatten_questions(questions: DataFrame) -> DataFrame:
    """Rows of ``read_questions`` with one column per metadata field; missing categories are empty."""
    fields = [F.col(f"metadata.{n}").alias(n) for n in IN_METADATA if n != "special_categories"]
    categories = F.coalesce("metadata.special_categories", F.array().cast("array<string>")).alias("special_categories")
    return questions.select(*[c for c in questions.columns if c != "metadata"], *fields, categories)


def nest_questions(questions: DataFrame) -> DataFrame:
    """The other way: the metadata columns that are there as one struct, as the readers give it."""
    inside = [n for n in IN_METADATA if n in questions.columns]
    return questions.select(*[c for c in questions.columns if c not in inside], F.struct(*inside).alias("metadata"))


def flatten_papers(papers: DataFrame) -> DataFrame:
    """Rows of ``read_papers`` with title, authors, abstract and keywords as columns."""
    return papers.select(*[c for c in papers.columns if c != "metadata"], *[F.col(f"metadata.{n}").alias(n) for n in OF_PAPER])


def paper_text(papers: DataFrame) -> DataFrame:
    """(paper_id, full_text): the text that the paper operators start from, sections in order."""
    heads = F.transform("sections", lambda s: F.concat_ws("\n", s["heading"], s["content"]))
    return papers.select("paper_id", F.array_join(heads, "\n\n").alias("full_text"))


def flatten_responses(responses: DataFrame) -> DataFrame:
    """Rows of ``read_evaluations`` with the question's own fields beside the response's.

    ``score`` is the first one there is: the response's own, its evaluation's, its ROUGE-L.
    """
    score = F.coalesce("score", "evaluation.score", "metrics.rouge.rougeL_fmeasure")
    of_question = ["question_id", "question", "paper_id", "gold_answer"]
    return responses.select(
        *[c for c in responses.columns if c not in ("question", "score", "evaluation", "metrics")], score.alias("score"),
        *[F.col(f"question.{n}").alias(n) for n in of_question],
        *[F.col(f"question.metadata.{n}").alias(n) for n in ("query_type", "complexity", "special_categories")])


def templates(read: DataFrame) -> dict[str, list[str]]:
    """Templates of ``read_templates`` for ``questions.generate``; the built-in ones if there are none.

    Templates are written by hand: more than ``MOST_TEMPLATES`` lines are an error.
    """
    rows = read.orderBy("query_type", "template_ix").limit(MOST_TEMPLATES + 1).toArrow().to_pylist()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row["query_type"], []).append(row["template"])
    return out or cat.TEMPLATES


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """(dimension, value, target) of a JSON file ``{dimension: {value: share}}``."""
    kind = "map<string,map<string,double>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return raw.select(F.explode("m").alias("dimension", "values")).select(
        "dimension", F.explode("values").alias("value", "target"))


def targets(spark: SparkSession, given: DataFrame | None = None) -> DataFrame:
    """Target shares (dimension, value, target): the given ones, and the built-in ones of every
    dimension that is not given."""
    rows = [(d, v, float(s)) for d, shares in SHARES.items() for v, s in shares.items()]
    built_in = spark.createDataFrame(rows, "dimension string, value string, target double")
    if given is None:
        return built_in
    rest = built_in.join(given.select("dimension").distinct(), "dimension", "left_anti")
    return given.select("dimension", "value", "target").unionByName(rest)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """(…, category, metric, value) with nested names as ``name.part`` (``rouge1.precision``)."""
    nested = F.regexp_replace("metric", r"^(rouge[0-9L]+|greedy)_(precision|recall|fmeasure|f1)$", "$1.$2")
    rest = [c for c in metrics.columns if c not in ("category", "metric", "value")]
    return metrics.select(*rest, "category", nested.alias("metric"), "value")
