"""Robustness, summaries and comparison tables of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.operators.ranking import exact_quantile, share

# Phrases that say a question cannot be answered.
REFUSALS = [
    "cannot answer", "unable to answer", "not possible to answer", "insufficient information",
    "not enough information", "cannot determine", "cannot be determined",
]
# The key metrics of the overview.
KEY_METRICS = [
    ("Retrieval", "Precision@5"), ("Retrieval", "MRR"),
    ("Answer", "ROUGE-rougeL_fmeasure"), ("Answer", "BERTScore-f1"),
]


def says_impossible(answer: Column) -> Column:
    return F.coalesce(F.lower(answer).rlike("|".join(REFUSALS)), F.lit(False))


def impossible_detection(responses: DataFrame, by: list[str]) -> DataFrame:
    """How often a question tagged impossible is refused. Needs ``tags`` (array)."""
    tagged = F.coalesce(F.array_contains("tags", "impossible"), F.lit(False))
    n = F.count_if(tagged)
    right = F.count_if(tagged & says_impossible(F.col("answer")))
    return (
        responses.where("success").groupBy(*by)
        .agg(n.alias("impossible_count"), F.count_if(~tagged).alias("possible_count"), right.alias("right"))
        .where("impossible_count > 0")
        .select(*by, share(F.col("right"), F.col("impossible_count")).alias("accuracy"),
                "impossible_count", "possible_count", "right",
                (F.col("impossible_count") - F.col("right")).alias("wrong"))
    )


def summary(responses: DataFrame, by: list[str]) -> DataFrame:
    """Totals, success rate and mean latency of successes per evaluation."""
    ok = F.count_if("success")
    return responses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_questions"), ok.alias("successful_queries"),
        share(ok, F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("latency"))), F.lit(0.0)).alias("average_latency"),
    )


def overview(responses: DataFrame, by: list[str]) -> DataFrame:
    """The summary with the day of the last response."""
    days = responses.groupBy(*by).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("day"))
    return summary(responses, by).join(days, by)


def effectiveness(metrics: DataFrame, by: list[str]) -> DataFrame:
    """0.4 × mean precision@k + 0.6 × (ROUGE-L F, else greedy F1).

    ``metrics`` is long with ``category, metric, value``. An absent part counts 0, and
    an evaluation needs both categories.
    """
    pick = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    return (
        metrics.groupBy(*by).agg(
            F.coalesce(F.avg(F.when(F.col("metric").startswith("precision@"), F.col("value"))), F.lit(0.0)).alias("retrieval"),
            F.coalesce(pick("rougeL_fmeasure"), pick("greedy_f1"), F.lit(0.0)).alias("answer"),
            F.count_if(F.col("category") == "retrieval").alias("n_retrieval"),
            F.count_if(F.col("category") == "answer").alias("n_answer"),
        )
        .where("n_retrieval > 0 AND n_answer > 0")
        .select(*by, (0.4 * F.col("retrieval") + 0.6 * F.col("answer")).alias("effectiveness"))
    )


def best_and_worst(responses: DataFrame, by: list[str], score: str = "score", ix: str = "question_ix",
                   k: int = 5) -> DataFrame:
    """First and last ``k`` by score, ties by index.

    The rank limit is applied in every task before rows meet, so one large
    evaluation sends only ``k`` rows per task.
    """
    best = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ix))
    worst = W.partitionBy(*by).orderBy(F.col(score), F.col(ix).desc())
    rows = responses.where("success")
    take = lambda w, kind: rows.withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= k).withColumn("kind", F.lit(kind))
    return take(best, "best").unionByName(take(worst, "worst"))


def examples_to_responses(examples: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """C14: the full response behind each example."""
    return responses.join(examples.select(*keys, "kind", "rank"), keys)


def flatten_metrics(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Nested metric structs or maps to ``(…, metric, value)`` with dotted names."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.MapType):
        return df.select(*keep, F.explode(column).alias("metric", "value"))
    parts = []
    for field in kind.fields:
        at = F.col(f"{column}.{field.name}")
        if isinstance(field.dataType, T.StructType):
            parts += [(f"{field.name}.{sub.name}", at[sub.name]) for sub in field.dataType.fields]
        elif isinstance(field.dataType, T.MapType):
            raise TypeError("explode map metrics before flattening a struct")
        else:
            parts.append((field.name, at))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in parts])
    return df.select(*keep, F.inline(rows)).where(F.col("value").isNotNull())


def compare_systems(metrics: DataFrame, systems: list[str] | None = None) -> DataFrame:
    """One row per (category, metric), one column per system."""
    grouped = metrics.groupBy("category", "metric")
    pivoted = grouped.pivot("system", systems) if systems else grouped.pivot("system")
    return pivoted.agg(F.first("value", ignorenulls=True))


def system_by(metrics: DataFrame, column: str, value: str, values: list[str]) -> DataFrame:
    """One row per system, one column per metric or type."""
    return metrics.groupBy("system").pivot(column, values).agg(F.first(value, ignorenulls=True))


def display_names(metrics: DataFrame) -> DataFrame:
    """The long metric table with the names reports show."""
    m = F.col("metric")
    name = (
        F.when(m.startswith("precision@"), F.concat(F.lit("Precision@"), F.substring_index(m, "@", -1)))
        .when(m.startswith("recall@"), F.concat(F.lit("Recall@"), F.substring_index(m, "@", -1)))
        .when(m == "mrr", "MRR").when(m == "bleu", "BLEU")
        .when(m.startswith("rouge"), F.concat(F.lit("ROUGE-"), m))
        .when(m.startswith("greedy_"), F.concat(F.lit("BERTScore-"), F.substring_index(m, "_", -1)))
        .when(m == "impossible_detection", "Impossible Detection").otherwise(m)
    )
    return metrics.withColumns({"category": F.initcap("category"), "metric": name})


def key_metrics(display: DataFrame, keys: list[tuple[str, str]] = KEY_METRICS) -> DataFrame:
    """The rows of the given (category, metric) pairs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(m).alias("m")) for c, m in keys])
    return display.where(F.array_contains(pairs, F.struct(F.col("category").alias("c"), F.col("metric").alias("m"))))


def filter_metrics(display: DataFrame, categories: list[str] | None = None,
                   metrics: list[str] | None = None) -> DataFrame:
    """C9."""
    out = display.where(F.col("category").isin(categories)) if categories else display
    return out.where(F.col("metric").isin(metrics)) if metrics else out


def scores_by(responses: DataFrame, column: str) -> DataFrame:
    """Mean score (0.5 without any) and count of successes per system and value."""
    value = F.coalesce(F.col(column), F.lit("unknown")).alias(column)
    score = F.coalesce(F.col("score"), F.lit(0.5))
    return responses.where("success").groupBy("system", value).agg(
        F.avg(score).alias("average_score"), F.count(F.lit(1)).alias("n"))


def latency_stats(responses: DataFrame) -> DataFrame:
    """Latency of successes per system; the median is the upper element."""
    rows = responses.where("success").select("system", F.coalesce("latency", F.lit(0.0)).alias("latency"))
    base = rows.groupBy("system").agg(
        F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"),
        F.avg("latency").alias("avg_latency"), F.count(F.lit(1)).alias("n"))
    return base.join(exact_quantile(rows, ["system"], "latency", upper=True, out="median_latency"), "system")


def variation(scores: DataFrame, column: str) -> DataFrame:
    """C11: spread of mean scores over types, for systems with more than one."""
    return scores.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), F.min("average_score").alias("min_score"),
        F.max("average_score").alias("max_score"), F.var_pop("average_score").alias("variance"),
        (F.max("average_score") - F.min("average_score")).alias("range"),
        F.min(F.struct(-F.col("average_score"), column)).getField(column).alias("best"),
        F.min(F.struct("average_score", column)).getField(column).alias("worst"),
    ).where("n > 1").drop("n")


def degradation(scores: DataFrame) -> DataFrame:
    """Loss from L1 to L3, absolute and in percent (0 when L1 is not positive)."""
    at = lambda level: F.max(F.when(F.col("complexity") == level, F.col("average_score")))
    both = scores.groupBy("system").agg(at("L1").alias("l1_score"), at("L3").alias("l3_score"))
    lost = F.col("l1_score") - F.col("l3_score")
    percent = F.when(F.col("l1_score") > 0, lost / F.when(F.col("l1_score") > 0, F.col("l1_score")) * 100).otherwise(0.0)
    return both.dropna(subset=["l1_score", "l3_score"]).select(
        "system", "l1_score", "l3_score", lost.alias("absolute"), percent.alias("percent"))


def search_examples(responses: DataFrame, query_type: str | None = None, text: str | None = None,
                    descending: bool = True, limit: int = 20, ix: str = "question_ix") -> DataFrame:
    """A top-k report of matching responses by latency."""
    out = responses
    if query_type:
        out = out.where(F.col("query_type") == query_type)
    if text:
        out = out.where(F.contains(F.lower("question"), F.lit(text.lower())))
    order = F.col("latency").desc() if descending else F.col("latency").asc()
    return out.orderBy(order, F.col(ix)).limit(limit)
