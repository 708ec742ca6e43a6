"""Answer quality: n-gram overlap, longest common subsequence, BLEU, greedy match."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.functions import text as tx

EPSILON = 0.1  # fixed value: a zero numerator of an n-gram precision


def _prf(overlap: Column, n_pred: Column, n_gold: Column) -> dict[str, Column]:
    p = F.when(n_pred > 0, overlap / F.greatest(n_pred, F.lit(1))).otherwise(0.0)
    r = F.when(n_gold > 0, overlap / F.greatest(n_gold, F.lit(1))).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r).otherwise(1.0)).otherwise(0.0)
    return {"precision": p, "recall": r, "fmeasure": f}


def with_counts(pairs: DataFrame, letters: str = "a-z0-9", rouge: bool = True, bleu: bool = True,
                lcs: bool = True) -> DataFrame:
    """All counts the scores need, computed once per ``(gold, answer)`` row.

    ``r{n}`` is the clipped n-gram overlap of the ROUGE tokens, ``b{n}`` of the BLEU
    tokens. Tokens are cut in the JVM; one Arrow pass counts, in time linear in the
    text. Nothing is exploded or shuffled.
    """
    count = _counter(rouge, bleu, lcs)
    cols = pairs.withColumns({
        "_rg": tx.tokens_rouge(F.col("gold"), letters), "_rp": tx.tokens_rouge(F.col("answer"), letters),
        "_bg": tx.tokens_strip(F.col("gold")), "_bp": tx.tokens_strip(F.col("answer")),
    })
    sizes = {"rouge_gold": F.size("_rg"), "rouge_pred": F.size("_rp"),
             "bleu_gold": F.size("_bg"), "bleu_pred": F.size("_bp")}
    return cols.withColumns({**sizes, "_c": count("_rp", "_rg", "_bp", "_bg")}).select(
        *pairs.columns, *sizes, "_c.*")


def clipped(a: list, b: list, n: int) -> int:
    """Sum over n-grams of the smaller of the two counts."""
    grams = lambda t: Counter(zip(*[t[i:] for i in range(n)]))
    return sum((grams(a) & grams(b)).values())


def _counter(rouge: bool, bleu: bool, lcs: bool):
    names = ["r1", "r2", "lcs", "b1", "b2", "b3", "b4"]

    def one(rp, rg, bp, bg) -> list:
        if rp is None or rg is None:
            return [None] * len(names)
        rp, rg, bp, bg = list(rp), list(rg), list(bp), list(bg)
        return [
            *[clipped(rp, rg, n) if rouge else None for n in (1, 2)],
            lcs_of(rp, rg) if lcs else None,
            *[clipped(bp, bg, n) if bleu else None for n in (1, 2, 3, 4)],
        ]

    @F.pandas_udf(", ".join(f"{n} int" for n in names))
    def count(rp: pd.Series, rg: pd.Series, bp: pd.Series, bg: pd.Series) -> pd.DataFrame:
        rows = [one(*row) for row in zip(rp, rg, bp, bg)]
        return pd.DataFrame(rows, columns=names).astype("Int32")

    return count


def rouge(n: int) -> dict[str, Column]:
    """M8 from the counts of ``with_counts``."""
    grams = lambda c: F.greatest(F.col(c) - (n - 1), F.lit(0))
    return _prf(F.col(f"r{n}"), grams("rouge_pred"), grams("rouge_gold"))


def rouge_l() -> dict[str, Column]:
    """M9 from the counts of ``with_counts``."""
    return _prf(F.col("lcs"), F.col("rouge_pred"), F.col("rouge_gold"))


def bleu() -> Column:
    """BLEU-4 with smoothing of zero numerators and the brevity penalty."""
    pred, gold = F.col("bleu_pred"), F.col("bleu_gold")
    total = F.lit(0.0)
    for n in (1, 2, 3, 4):
        hits = F.col(f"b{n}").cast("double")
        total = total + F.ln(F.when(hits > 0, hits).otherwise(EPSILON) / F.greatest(pred - (n - 1), F.lit(1)))
    penalty = F.when(pred > gold, 1.0).otherwise(F.exp(1 - gold / F.greatest(pred, F.lit(1))))
    return F.when((pred == 0) | (F.col("b1") == 0), 0.0).otherwise(penalty * F.exp(total / 4))


def lcs_of(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word per 64 tokens of ``a``."""
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def answer_scores(pairs: DataFrame, rouge_n: bool = True, lcs: bool = True, with_bleu: bool = True) -> DataFrame:
    """Every text score of ``(…, gold, answer)`` rows as columns.

    Rows with an empty side get no scores, so averages leave them out.
    """
    counted = with_counts(pairs, rouge=rouge_n, bleu=with_bleu, lcs=lcs)
    usable = (F.coalesce(F.length("gold"), F.lit(0)) > 0) & (F.coalesce(F.length("answer"), F.lit(0)) > 0)
    named: dict[str, Column] = {}
    if rouge_n:
        named.update({f"rouge{n}_{k}": c for n in (1, 2) for k, c in rouge(n).items()})
    if lcs:
        named.update({f"rougeL_{k}": c for k, c in rouge_l().items()})
    if with_bleu:
        named["bleu"] = bleu()
    return counted.select(*pairs.columns, *[F.when(usable, c).alias(k) for k, c in named.items()])


SCORE_NAMES = [f"rouge{n}_{k}" for n in ("1", "2", "L") for k in ("precision", "recall", "fmeasure")] + ["bleu"]


def answer_metrics(scored: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """Averages of the scores as a long table ``(…, metric, value)``."""
    names = names or [n for n in SCORE_NAMES if n in scored.columns]
    wide = scored.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select(*by, F.inline(pairs))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")]))
def greedy_match(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """Mean over tokens of the best cosine with the other side, and the F1.

    Takes the token vectors of both sides as arrays of arrays.
    """
    out = np.full((len(pred), 3), np.nan)
    for i, (p, g) in enumerate(zip(pred, gold)):
        if p is None or g is None or not len(p) or not len(g):
            continue
        a, b = np.stack(list(p)).astype(np.float64), np.stack(list(g)).astype(np.float64)
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        cos = np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)
        x, y = cos.max(1).mean(), cos.max(0).mean()
        out[i] = x, y, 2 * x * y / (x + y) if x + y else 0.0
    return pd.DataFrame(out, columns=["precision", "recall", "f1"]).astype("float64")
