"""Readers of questions, papers, templates and evaluation results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill import schemas
from qamill.functions import text as tx


def read_questions(spark: SparkSession, path: str, only_gold: bool = False, lines: bool = False) -> DataFrame:
    """Questions from JSON files that hold a list or a single object, or with ``lines`` one
    object per line, as ``sinks.write_json`` leaves them."""
    rows = (
        spark.read.schema(schemas.QUESTION).option("multiLine", not lines)
        .option("recursiveFileLookup", True).json(path)
        .withColumn("source", F.input_file_name())
    )
    return rows.where(F.col("gold_answer").isNotNull()) if only_gold else rows


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.PAPER).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return rows.withColumn("paper_id", F.coalesce("paper_id", stem))


def with_paper(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Questions whose paper exists, with the paper as one struct column."""
    held = papers.select(F.col("paper_id"), F.struct(*[c for c in papers.columns if c != "paper_id"]).alias("paper"))
    return questions.join(held, "paper_id")


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """The last evaluation of every system, one row per response.

    Files are ranked by the time that their own stamp means (ISO text or seconds), then name; only the small key columns
    take part in the ranking, the responses are joined back afterwards.
    """
    raw = (
        spark.read.schema(schemas.EVALUATION).option("multiLine", True).json(path)
        .withColumn("file", F.input_file_name())
        .withColumn("system_name", F.coalesce("system.name", F.lit("unknown")))
    )
    when = event_time(F.col("timestamp")).alias("at")
    last = raw.groupBy("system_name").agg(F.max(F.struct(when, "file")).alias("last"))
    keep = last.select("system_name", F.col("last.file").alias("file"))
    rows = raw.join(keep, ["system_name", "file"])
    return rows.select(
        F.col("file").alias("eval_id"), F.col("system_name").alias("system"),
        F.posexplode("responses").alias("question_ix", "r"),
    ).select("eval_id", "system", F.col("question_ix").cast("bigint").alias("question_ix"),
             "r.*").withColumn("ts", event_time(F.col("timestamp"))).drop("timestamp")


def latest_per_system(files: DataFrame) -> DataFrame:
    """The newest file per system from ``(system, file, mtime)``."""
    return files.groupBy("system").agg(F.max(F.struct("mtime", "file")).alias("m")).select(
        "system", F.col("m.file").alias("file"))


def event_time(value: Column) -> Column:
    """A timestamp from an ISO text or a number of seconds."""
    number = value.try_cast("double")
    return F.coalesce(F.timestamp_micros((number * 1000000).cast("bigint")), value.try_cast("timestamp"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """One text file per query type, blank lines dropped, in line order."""
    lines = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return (
        lines.select(
            F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("query_type"),
            F.filter(F.transform(F.split("value", "\n"), tx.strip), lambda x: x != "").alias("items"),
        )
        .select("query_type", F.posexplode("items").alias("template_ix", "template"))
    )


def parse_payload(raw: Column) -> tuple[Column, Column]:
    """Answer and contexts of a raw JSON payload.

    Answer is the first present of ``answer``, ``text``, ``result``, else the whole
    payload; contexts is ``contexts``, else the single ``context`` as a list.
    """
    answer = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("answer", "text", "result")], raw)
    kind = "array<struct<id:string,text:string,score:double>>"
    one = "struct<id:string,text:string,score:double>"
    many = F.from_json(F.get_json_object(raw, "$.contexts"), kind)
    single = F.from_json(F.get_json_object(raw, "$.context"), one)
    return answer, F.coalesce(many, F.when(single.isNotNull(), F.array(single)))


def normalise_responses(raw: DataFrame) -> DataFrame:
    """Answer and contexts for successes; failures keep their error, latency 0."""
    answer, contexts = parse_payload(F.col("raw"))
    ok = F.col("success")
    return raw.withColumns({
        "answer": F.when(ok, answer), "contexts": F.when(ok, contexts),
        "latency": F.when(ok, F.col("latency")).otherwise(F.lit(0.0)),
    })


def ask(questions: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
        schema: str, parallel: int | None = None) -> DataFrame:
    """Send every question through a user function over batches.

    ``parallel`` sets how many tasks call it at once.
    """
    rows = questions.repartition(parallel) if parallel else questions
    return rows.mapInPandas(fn, schema)

