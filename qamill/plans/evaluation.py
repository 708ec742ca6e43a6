"""Responses to scores, metrics, summaries and comparison tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.operators import answers as an
from qamill.operators import retrieval as rt
from qamill.operators import summary as su


@dataclass(frozen=True)
class MetricFlags:
    """Which metrics are built; what is off never enters the plan."""

    precision: bool = True
    recall: bool = True
    mrr: bool = True
    ndcg: bool = False
    k_values: tuple[int, ...] = rt.K_VALUES
    rouge: bool = True
    rouge_l: bool = True
    bleu: bool = True
    impossible_detection: bool = True
    text_match: float = rt.TEXT_MATCH

    def retrieval_names(self) -> list[str]:
        kinds = [("precision", self.precision), ("recall", self.recall), ("ndcg", self.ndcg)]
        names = [f"{kind}@{k}" for kind, on in kinds if on for k in self.k_values]
        return names + (["mrr"] if self.mrr else [])

    def answer_names(self) -> list[str]:
        out = []
        for n, on in (("1", self.rouge), ("2", self.rouge), ("L", self.rouge_l)):
            out += [f"rouge{n}_{k}" for k in ("precision", "recall", "fmeasure")] if on else []
        return out + (["bleu"] if self.bleu else [])


@dataclass(frozen=True)
class Evaluation:
    scored: DataFrame
    metrics: DataFrame
    summary: DataFrame
    examples: DataFrame


def score_responses(responses: DataFrame, flags: MetricFlags = MetricFlags()) -> DataFrame:
    """Every score of every success as columns, in the row; no shuffle.

    Needs ``contexts`` and ``gold`` (arrays of id and text), ``gold_text``, ``answer``.
    """
    out = responses.where("success")
    names = flags.retrieval_names()
    if names:
        usable = (F.coalesce(F.size("contexts"), F.lit(0)) > 0) & (F.coalesce(F.size("gold"), F.lit(0)) > 0)
        out = out.withColumn("_flags", F.when(
            usable, rt.relevance(F.col("contexts"), F.col("gold"), flags.text_match)))
        scores = rt.retrieval_scores(F.col("_flags"), F.size("gold"), flags.k_values)
        out = out.withColumns({n: F.when(F.col("_flags").isNotNull(), scores[n]) for n in names}).drop("_flags")
    if flags.answer_names():
        pairs = out.withColumns({"_gold": F.col("gold"), "gold": F.col("gold_text")})
        scored = an.answer_scores(pairs, rouge_n=flags.rouge, lcs=flags.rouge_l, with_bleu=flags.bleu)
        out = scored.withColumn("gold", F.col("_gold")).drop("_gold")
    return out


def metrics_of(scored: DataFrame, by: list[str], flags: MetricFlags = MetricFlags()) -> DataFrame:
    """Averages of all score columns as ``(…, category, metric, value)``: one aggregation."""
    names = [("retrieval", n) for n in flags.retrieval_names()] + [("answer", n) for n in flags.answer_names()]
    aggs = [F.avg(f"`{n}`").alias(n) for _, n in names]
    if flags.impossible_detection:
        tagged = F.array_contains("tags", "impossible")
        aggs.append(F.avg(F.when(tagged, su.says_impossible(F.col("answer")).cast("double"))).alias("impossible_detection"))
        names.append(("robustness", "impossible_detection"))
    if not aggs:
        raise ValueError("no metric is switched on")
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value"))
                     for c, n in names])
    return scored.groupBy(*by).agg(*aggs).select(*by, F.inline(rows)).where(F.col("value").isNotNull())


def evaluate(responses: DataFrame, by: list[str] = ("system",), flags: MetricFlags = MetricFlags(),
             store=lambda df, name: df) -> Evaluation:
    """The whole evaluation. ``store`` writes a layer once and reads it back
    (``qamill.session.materialise`` on a cluster); metrics, examples and bias read it.
    """
    by = list(by)
    scored = store(score_responses(responses, flags), "scored")
    metrics = metrics_of(scored, by, flags)
    summary = su.summary(responses, by).join(su.effectiveness(metrics, by), by, "left")
    score = F.col("rougeL_fmeasure") if flags.rouge_l else F.lit(0.0)
    ranked = scored.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return Evaluation(scored, metrics, summary, su.best_and_worst(ranked, by))
