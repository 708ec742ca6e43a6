"""Bias statistics of question sets and of system performance.

Every statistic is a sum, a count or an extreme per group, so partial aggregation
absorbs hot groups before any shuffle. Lists of scores are never gathered.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.functions.rows import unnest
from qamill.functions.stats import f_tail_udf
from qamill.operators.ranking import exact_quantile, share

UNEVEN = 0.7
STRONG = 0.5
SIGNIFICANT = 0.05
SHORT_CHARS, SHORT_WORDS = 20, 5


def field_values(rows: DataFrame, scalars: list[str], arrays: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Rows × fields as ``(…, field, value)``; null is ``unknown``, no tag is ``none``.

    Each array element is a value of its own.
    """
    parts = [
        F.array(F.struct(F.lit(f).alias("field"),
                         F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")))
        for f in scalars
    ]
    for f in arrays:
        tags = F.coalesce(F.col(f), F.array().cast("array<string>"))
        tags = F.when(F.size(tags) == 0, F.array(F.lit("none"))).otherwise(tags)
        parts.append(F.arrays_zip(F.array_repeat(F.lit(f), F.size(tags)).alias("field"), tags.alias("value")))
    return unnest(rows, F.concat(*parts), list(keep)).select(*keep, "item.*")


def distribution(rows: DataFrame, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    """B1/B2: count and share of each value of each field; shares of tags for arrays."""
    counts = field_values(rows, scalars, arrays).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    # At most one row per field.
    return counts.join(F.broadcast(totals), "field").select(
        "field", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def evenness(dist: DataFrame) -> DataFrame:
    """Shannon entropy over its maximum; 1 with one category or none."""
    entropy = -F.sum(F.col("share") * F.ln("share"))
    return dist.groupBy("field").agg(
        F.when(F.count(F.lit(1)) <= 1, 1.0).otherwise(
            entropy / F.ln(F.greatest(F.count(F.lit(1)), F.lit(2)))).alias("evenness"),
        F.count(F.lit(1)).alias("categories"),
    )


def uneven_flags(dist: DataFrame, optional: tuple[str, ...] = (), threshold: float = UNEVEN) -> DataFrame:
    """Fields with low evenness and their dominant value (first by name on ties)."""
    top = dist.groupBy("field").agg(F.min(F.struct(-F.col("n"), "value", "share")).alias("top"))
    return (
        evenness(dist).where(~F.col("field").isin(list(optional)) & (F.col("evenness") < threshold))
        .join(top, "field")
        .select("field", "evenness", F.col("top.value").alias("dominant_value"),
                F.col("top.share").alias("dominant_share"))
    )


def cells(rows: DataFrame, field1: str, field2: str) -> DataFrame:
    """Non-empty cells of the contingency table of two fields."""
    value = lambda f, out: F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(out)
    return rows.select(value(field1, "value1"), value(field2, "value2")).groupBy(
        "value1", "value2").agg(F.count(F.lit(1)).alias("n"))


def contingency(rows: DataFrame, field1: str, field2: str, values2: list[str] | None = None) -> DataFrame:
    """The contingency table, one row per cell.

    Without ``values2`` the seen cells only. With it (the names of a taxonomy) every value of
    ``field1`` also gets a cell, if need be of 0, for each of them. Nothing is collected per value.
    """
    full = cells(rows, field1, field2)
    if values2 is None:
        return full
    empty = full.select("value1").distinct().select(
        "value1", F.explode(F.array(*[F.lit(v) for v in values2])).alias("value2"), F.lit(0).cast("long").alias("n"))
    return full.unionByName(empty).groupBy("value1", "value2").agg(F.sum("n").alias("n"))


def cramers_v(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cramér's V of non-empty cells ``(by…, value1, value2, n)``.

    χ² = n(Σ o²/(r·c) − 1) needs no empty cells. A 2×2 table gets the continuity
    correction: all four |o − e| are equal there, so the largest seen one serves.
    """
    by = list(by)
    rows = table.groupBy(*by, "value1").agg(F.sum("n").alias("r"))
    cols = table.groupBy(*by, "value2").agg(F.sum("n").alias("c"))
    n_rows = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("total"), F.sum(1 / F.col("r")).alias("inv_r"))
    n_cols = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    join = (lambda a, b, on: a.join(b, on) if on else a.crossJoin(F.broadcast(b)))  # one row when no key
    whole = join(n_rows, n_cols, by)
    full = join(table.join(rows, by + ["value1"]).join(cols, by + ["value2"]), whole, by)
    expected = F.col("r") * F.col("c") / F.col("total")
    stats = full.groupBy(*by).agg(
        F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"),
        F.max(F.abs(F.col("n") - expected)).alias("off"),
        *[F.max(c).alias(c) for c in ("n_rows", "n_cols", "total", "inv_r", "inv_c")],
    )
    plain = F.col("total") * (F.col("s") - 1)
    off = F.col("off") - F.least(F.lit(0.5), F.col("off"))
    yates = off * off * F.col("total") * F.col("inv_r") * F.col("inv_c")
    square = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    chi2 = F.greatest(F.when(square, yates).otherwise(plain), F.lit(0.0))
    dim = F.least("n_rows", "n_cols") - 1
    v = F.when(dim > 0, F.sqrt(chi2 / (F.col("total") * F.greatest(dim, F.lit(1))))).otherwise(0.0)
    return stats.select(*by, F.col("total").alias("n"), "n_rows", "n_cols",
                        F.when(dim > 0, chi2).otherwise(0.0).alias("chi2"), v.alias("cramers_v"))


def field_pairs(rows: DataFrame, fields: list[str], threshold: float = STRONG) -> DataFrame:
    """Association of every pair of fields in one pass, strong pairs flagged."""
    pairs = F.array(*[
        F.struct(F.lit(f"{a}_{b}").alias("pair"),
                 F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("value1"),
                 F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias("value2"))
        for a, b in combinations(fields, 2)
    ])
    table = rows.select(F.inline(pairs)).groupBy("pair", "value1", "value2").agg(
        F.count(F.lit(1)).alias("n"))
    return cramers_v(table, ["pair"]).withColumn("strong", F.col("cramers_v") > threshold)


def text_stats(rows: DataFrame, text: str = "question", by: list[str] = ()) -> DataFrame:
    """Characters and words: mean, min, max, median, population deviation.

    Lengths are whole numbers with few distinct values, so the exact percentile,
    which counts distinct values, stays small for any group.
    """
    sized = rows.select(*by, F.length(text).alias("chars"), F.size(tx.words(F.col(text))).alias("words"))
    out = []
    for c in ("chars", "words"):
        out += [F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
                F.percentile(c, 0.5).alias(f"median_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *out)


def short_text_flags(stats: DataFrame, min_chars: float = SHORT_CHARS, min_words: float = SHORT_WORDS) -> DataFrame:
    """B10."""
    issues = F.array_compact(F.array(
        F.when(F.col("mean_chars") < min_chars, F.struct(
            F.lit("too_short_questions").alias("issue"), F.col("mean_chars").alias("value"))),
        F.when(F.col("mean_words") < min_words, F.struct(
            F.lit("too_few_words").alias("issue"), F.col("mean_words").alias("value"))),
    ))
    return stats.select(F.inline(issues))


def response_score(score: Column, evaluation: Column, rouge: Column, gold: Column, answer: Column) -> Column:
    """The first score present, else token overlap with gold, else 0.5."""
    texts = (F.coalesce(F.length(gold), F.lit(0)) > 0) & (F.coalesce(F.length(answer), F.lit(0)) > 0)
    overlap = F.when(texts, tx.jaccard(
        F.array_distinct(tx.tokens_word(gold)), F.array_distinct(tx.tokens_word(answer))))
    return F.coalesce(score, evaluation, rouge, overlap, F.lit(0.5))


def scores_by_field(responses: DataFrame, scalars: list[str], arrays: list[str] = (),
                    median: bool = True) -> DataFrame:
    """Score statistics per system, field and value over successes.

    Needs ``system, success, score``. The exact median is a second pass and can be
    left out.
    """
    long = field_values(responses.where("success"), scalars, arrays, keep=["system", "score"])
    keys = ["system", "field", "value"]
    out = long.groupBy(*keys).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"),
        F.max("score").alias("max"), F.stddev_pop("score").alias("std"),
    )
    if median:
        out = out.join(exact_quantile(long, keys, "score", out="median"), keys)
    return out


def anova(groups: DataFrame) -> DataFrame:
    """One-way ANOVA per system and field from the group statistics alone.

    F is null without spare observations; equal values within every group give an
    infinite F and p = 0.
    """
    total = groups.groupBy("system", "field").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("std") * F.col("std")).alias("ssw"),
    )
    between = (
        groups.select("system", "field", F.col("n").alias("gn"), F.col("mean").alias("gm"))
        .join(total, ["system", "field"])
        .groupBy("system", "field")
        .agg(F.sum(F.col("gn") * (F.col("gm") - F.col("grand")) * (F.col("gm") - F.col("grand"))).alias("ssb"),
             *[F.max(c).alias(c) for c in ("n", "k", "ssw")])
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    spread = F.col("ssw") > 0
    f = (
        F.when((d1 <= 0) | (d2 <= 0), F.lit(None).cast("double"))
        .when(spread, (F.col("ssb") / F.greatest(d1, F.lit(1)))
              / (F.when(spread, F.col("ssw")).otherwise(1.0) / F.greatest(d2, F.lit(1))))
        .when(F.col("ssb") > 0, F.lit(float("inf")))
    )
    out = between.select("system", "field", "n", "k", f.alias("f_value"))
    return out.withColumn("p_value", f_tail_udf(
        F.col("f_value"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    )).withColumn("p_value", F.when(F.col("f_value").isNotNull(), F.col("p_value"))).withColumn(
        "significant", F.coalesce(F.col("p_value") < SIGNIFICANT, F.lit(False)))


def disparities(groups: DataFrame, tests: DataFrame) -> DataFrame:
    """Best and worst value where the test is significant, first by name on ties."""
    ends = groups.groupBy("system", "field").agg(
        F.min(F.struct(-F.col("mean"), "value")).alias("b"), F.min(F.struct("mean", "value")).alias("w"),
        (F.max("mean") - F.min("mean")).alias("gap"),
    )
    return tests.where("significant").join(ends, ["system", "field"]).select(
        "system", "field", "p_value", F.col("b.value").alias("best"), F.col("w.value").alias("worst"), "gap")


def group_stats(responses: DataFrame, fields: list[str]) -> DataFrame:
    """Count, share, success rate and mean score of successes per group.

    Null groups count as ``unknown`` on every column.
    """
    long = field_values(responses, fields, keep=["system", "success", "score"])
    groups = long.groupBy("system", "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("score"))), F.lit(0.0)).alias("score"),
    )
    totals = responses.groupBy("system").agg(F.count(F.lit(1)).alias("total"))
    return groups.join(totals, "system").select(
        "system", "field", "value", "n", share(F.col("n"), F.col("total")).alias("share"),
        share(F.col("ok"), F.col("n")).alias("success_rate"), "score")


def group_outliers(groups: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Groups more than ``sigmas`` sample deviations from the mean of groups."""
    spread = groups.groupBy("system", "field").agg(
        F.avg("score").alias("m"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("s"))
    off = F.col("score") - F.col("m")
    return (
        groups.join(spread, ["system", "field"])
        .where((F.col("s") > 0) & (F.abs(off) > sigmas * F.col("s")))
        .select("system", "field", "value", "score", off.alias("difference"),
                (off / F.when(F.col("s") > 0, F.col("s"))).alias("deviations"))
    )
