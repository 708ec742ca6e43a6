"""Bias statistics against published values and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from qamill.functions.stats import f_tail
from qamill.operators import bias as bi
from qamill.operators import summary as su

TYPES = {"factoid": [1.0, 0.0, 0.8125, 0.9230769230769231, 1.0, 0.0, 0.7142857142857143, 0.0, 0.6666666666666666, 0.0],
         "definitional": [0.7222222222222222, 0.6153846153846154, 0.7142857142857143, 0.6153846153846154, 0.75],
         "procedural": [0.8333333333333334, 0.6666666666666666, 0.6428571428571429, 0.75],
         "comparative": [0.7222222222222222, 0.7777777777777778, 1.0, 0.9333333333333333],
         "causal": [1.0, 0.7333333333333333, 1.0, 0.6666666666666666], "open_ended": [1.0, 0.8333333333333334],
         "quantitative": [0.8]}
LEVELS = {"L2": [1.0, 0.8125, 0.0, 0.6153846153846154, 0.7142857142857143, 1.0, 0.7333333333333333, 1.0, 0.8333333333333334, 0.9333333333333333, 0.75],
          "L1": [0.0, 0.9230769230769231, 1.0, 0.7222222222222222, 0.6153846153846154, 1.0, 0.0, 0.6666666666666666, 0.6666666666666666, 0.6666666666666666, 0.0],
          "L3": [0.8333333333333334, 0.7222222222222222, 0.7777777777777778, 1.0, 0.7142857142857143, 0.75, 0.6428571428571429, 0.8]}
CELLS = {"causal": (1, 3, 0), "comparative": (1, 1, 2), "definitional": (2, 2, 1), "factoid": (9, 5, 1),
         "open_ended": (0, 1, 1), "procedural": (1, 1, 2), "quantitative": (0, 0, 1)}


def scored(spark, groups, field):
    rows = [("s", True, s, g) for g, scores in groups.items() for s in scores]
    return spark.createDataFrame(rows, f"system string, success boolean, score double, {field} string")


@pytest.mark.parametrize("groups, field, f, p", [
    (TYPES, "query_type", 1.2226008845723915, 0.33084167136673004),
    (LEVELS, "complexity", 1.5815962083147663, 0.22411308023362836)])
def test_anova_matches_published_values(spark, groups, field, f, p):
    stats = bi.scores_by_field(scored(spark, groups, field), [field])
    got = bi.anova(stats).first()
    assert math.isclose(got["f_value"], f, rel_tol=1e-12) and math.isclose(got["p_value"], p, rel_tol=1e-10)
    assert not got["significant"]


def test_group_scores_match_published_values(spark):
    got = {r["value"]: r for r in bi.scores_by_field(scored(spark, TYPES, "query_type"), ["query_type"]).collect()}
    assert math.isclose(got["factoid"]["mean"], 0.5116529304029305) and math.isclose(got["factoid"]["median"], 0.6904761904761905)
    assert math.isclose(got["factoid"]["std"], 0.42999867093924815) and got["quantitative"]["std"] == 0
    assert math.isclose(got["comparative"]["median"], 0.8555555555555556)


def questions(spark):
    rows = [(t, f"L{i + 1}") for t, counts in CELLS.items() for i, n in enumerate(counts) for _ in range(n)]
    return spark.createDataFrame(rows, "query_type string, complexity string")


def test_evenness_and_association_match_published_values(spark):
    even = {r["field"]: r["evenness"] for r in bi.evenness(bi.distribution(questions(spark), ["query_type", "complexity"])).collect()}
    # the complexity margins here are 14, 13, 8
    assert math.isclose(even["query_type"], 0.8478942787026135) and math.isclose(even["complexity"], 0.975529530533018)
    got = bi.field_pairs(questions(spark), ["query_type", "complexity"]).first()
    assert math.isclose(got["cramers_v"], 0.4511127877291302, rel_tol=1e-12) and not got["strong"]


def test_degenerate_and_two_by_two(spark):
    one_column = spark.createDataFrame([("a", "x"), ("b", "x")], "p string, q string")
    assert bi.cramers_v(bi.cells(one_column, "p", "q")).first()["cramers_v"] == 0
    rows = [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 1 + [("b", "y")] * 5
    n, o = 16, {("a", "x"): 8, ("a", "y"): 2, ("b", "x"): 1, ("b", "y"): 5}
    r, c = {"a": 10, "b": 6}, {"x": 9, "y": 7}
    chi = sum((abs(v - r[i] * c[j] / n) - 0.5) ** 2 / (r[i] * c[j] / n) for (i, j), v in o.items())
    got = bi.cramers_v(bi.cells(spark.createDataFrame(rows, "p string, q string"), "p", "q")).first()
    assert math.isclose(got["cramers_v"], math.sqrt(chi / n))
    diagonal = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 3, "p string, q string")
    assert math.isclose(bi.cramers_v(bi.cells(diagonal, "p", "q")).first()["chi2"], 6 * (1.5 - 0.5) ** 2 / 1.5 * 4 / 6)


def test_array_field_counts_tags(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["a"],)], "tags array<string>")
    got = {r["value"]: (r["n"], r["share"]) for r in bi.distribution(df, [], ["tags"]).collect()}
    assert got == {"a": (2, 0.4), "b": (1, 0.2), "none": (2, 0.4)}


def test_anova_guards(spark):
    one_each = bi.scores_by_field(scored(spark, {"a": [1.0], "b": [0.5]}, "f"), ["f"])
    assert bi.anova(one_each).first()["p_value"] is None
    constant = bi.scores_by_field(scored(spark, {"a": [1.0, 1.0], "b": [0.5, 0.5]}, "f"), ["f"])
    row = bi.anova(constant).first()
    assert math.isinf(row["f_value"]) and row["p_value"] == 0 and row["significant"]
    flag = bi.disparities(constant, bi.anova(constant)).first()
    assert (flag["best"], flag["worst"], flag["gap"]) == ("a", "b", 0.5)
    assert math.isclose(f_tail(4.0, 2, 10), 1.8 ** -5) and f_tail(0.0, 2, 2) == 1.0  # closed form for d1 = 2


def test_unknown_groups_have_both_count_and_score(spark):
    df = spark.createDataFrame([("s", True, 0.5, None), ("s", False, None, None), ("s", True, 1.0, "a")],
                               "system string, success boolean, score double, f string")
    got = {r["value"]: r for r in bi.group_stats(df, ["f"]).collect()}
    assert got["unknown"]["n"] == 2 and got["unknown"]["success_rate"] == 0.5 and got["unknown"]["score"] == 0.5


def test_outliers_need_more_than_five_groups(spark):
    def flags(n):
        rows = [("s", True, 0.0 if i else 1.0, f"g{i}") for i in range(n)]
        df = spark.createDataFrame(rows, "system string, success boolean, score double, f string")
        return bi.group_outliers(bi.group_stats(df, ["f"])).count()
    assert flags(5) == 0 and flags(6) == 1


def test_score_chain(one):
    col = lambda v: F.lit(v).cast("double")
    score = lambda s, e, r, g, a: one(bi.response_score(col(s), col(e), col(r), F.lit(g), F.lit(a)))
    assert score(0.1, 0.2, 0.3, "a", "a") == 0.1 and score(None, 0.2, 0.3, "a", "a") == 0.2
    assert score(None, None, 0.3, "a", "a") == 0.3 and score(None, None, None, "a b", "b c") == 1 / 3
    assert score(None, None, None, "", "b") == 0.5


def test_flatten_and_compare(spark):
    df = \
        spark.createDataFrame([("s", ((0.5, 0.25), 0.1))], "system string, m struct<precision:struct<a:double,b:double>,mrr:double>")
    got = {r["metric"]: r["value"] for r in su.flatten_metrics(df, "m", ["system"]).collect()}
    assert got == {"precision.a": 0.5, "precision.b": 0.25, "mrr": 0.1}
    long = spark.createDataFrame([("s", "c", "m", 1.0), ("t", "c", "m", 2.0), ("t", "c", "k", 3.0)],
                                 "system string, category string, metric string, value double")
    wide = {r["metric"]: (r["s"], r["t"]) for r in su.compare_systems(long).collect()}
    assert wide == {"m": (1.0, 2.0), "k": (None, 3.0)}
