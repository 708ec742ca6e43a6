"""Answer and retrieval metrics against plain Python."""

import math
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qamill.operators import answers as an
from qamill.operators import retrieval as rt
from qamill.operators import summary as su
from qamill.plans import evaluation


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_lcs_matches_dynamic_programming(a, b):
    assert an.lcs_of(a, b) == slow_lcs(a, b)


def slow_bleu(gold, pred):
    g, p = gold.lower().split(), pred.lower().split()
    if not p:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        grams = lambda t: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
        hits = sum((grams(p) & grams(g)).values())
        if n == 1 and hits == 0:
            return 0.0
        logs += math.log((hits or 0.1) / max(1, len(p) - n + 1))
    return (1 if len(p) > len(g) else math.exp(1 - len(g) / len(p))) * math.exp(logs / 4)


PAIRS = [
    ("the cat sat on the mat", "the cat sat on the mat"), ("the cat sat on the mat", "the the the"),
    ("a b c d e f", "f e d c b a"), ("one two", "three four"), ("x", "x y z w v"), ("a b a b a b", "b a b a"),
]


def test_answer_scores(spark):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(PAIRS)], "i int, gold string, answer string")
    got = {r["i"]: r for r in an.answer_scores(df).collect()}
    for i, (g, p) in enumerate(PAIRS):
        a, b = g.split(), p.split()
        lcs = slow_lcs(a, b)
        assert math.isclose(got[i]["rougeL_precision"], lcs / len(b))
        assert math.isclose(got[i]["rougeL_recall"], lcs / len(a))
        assert math.isclose(got[i]["rouge1_recall"], sum((Counter(a) & Counter(b)).values()) / len(a))
        assert math.isclose(got[i]["bleu"], slow_bleu(g, p), abs_tol=1e-12)
    assert got[0]["bleu"] == 1.0 and got[0]["rouge2_fmeasure"] == 1.0


def test_empty_answers_are_left_out_of_averages(spark):
    df = spark.createDataFrame([("s", "a b", "a b"), ("s", "a b", ""), ("s", "a", None)], "system string, gold string, answer string")
    got = {r["metric"]: r["value"] for r in an.answer_metrics(an.answer_scores(df), ["system"]).collect()}
    assert got["rouge1_fmeasure"] == 1.0 and got["rougeL_recall"] == 1.0


def responses(spark, rows):
    kind = ("system string, success boolean, latency double, question_ix long, answer string, gold_text string, tags array<string>, "
            "contexts array<struct<id:string,text:string>>, gold array<struct<id:string,text:string>>")
    return spark.createDataFrame(rows, kind)


def test_relevance_rules(spark):
    df = responses(spark, [("s", True, 1.0, 0, "a", "a", [], [
        ("P1", "other text"), ("zz", "gold words here"), ("", "gold words here"), (None, "gold words"), ("P1", "")],
        [("P1", "gold words here"), ("P2", "second")])])
    # id hit; wrong id is not matched by text; text hit; overlap 2/3 is too low; a repeated id counts again
    assert df.select(rt.relevance(F.col("contexts"), F.col("gold")).alias("x")).first()["x"] == [True, False, True, False, True]


def test_retrieval_scores(spark):
    flags = F.array(*[F.lit(x) for x in (False, True, True)])
    got = spark.range(1).select(*[c.alias(n) for n, c in rt.retrieval_scores(flags, F.lit(2)).items()]).first().asDict()
    assert got["precision@1"] == 0 and math.isclose(got["precision@5"], 2 / 3) and got["precision@10"] == got["precision@5"]
    assert got["recall@1"] == 0 and got["recall@3"] == 1 and got["mrr"] == 0.5
    best = 1 + 1 / math.log2(3)
    assert math.isclose(got["ndcg@3"], (1 / math.log2(3) + 0.5) / best)


def test_macro_average_skips_empty_sides(spark):
    df = responses(spark, [
        ("s", True, 1.0, 0, "a", "a", [], [("P1", "t")], [("P1", "t")]),
        ("s", True, 1.0, 1, "a", "a", [], [], [("P1", "t")]),
        ("s", True, 1.0, 2, "a", "a", [], [("P1", "t")], []),
        ("s", True, 1.0, 3, "a", "a", [], [("P9", "t")], [("P1", "t")]),
    ])
    got = {r["metric"]: r["value"] for r in rt.retrieval_metrics(df, ["system"]).collect()}
    assert got["precision@5"] == 0.5 and got["mrr"] == 0.5


def test_dense_top_k_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[7] = vectors[3]  # a tie
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    queries = df.where("id < 40")
    want = {}
    for q in range(40):
        dist = ((vectors.astype("float64") - vectors[q].astype("float64")) ** 2).sum(1)
        order = sorted((d, i) for i, d in enumerate(dist) if i != q)[:4]
        want[q] = [i for _, i in order]
    small = rt.dense_top_k(queries, df, 4, skip_self=True)
    grid = rt.dense_top_k(queries, df, 4, skip_self=True, query_block=7, corpus_block=11)
    for result in (small, grid):
        got = {}
        for r in sorted(result.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want
    assert rt.dense_top_k(queries.where("id < 0"), df, 4).count() == 0
    named = lambda d: d.selectExpr("lpad(hex(id), 4, '0') AS id", "vector")
    texts = rt.dense_top_k(named(queries), named(df), 4, skip_self=True)
    got = {}
    for r in sorted(texts.collect(), key=lambda r: r["rank"]):
        got.setdefault(int(r["query_id"], 16), []).append(int(r["doc_id"], 16))
    assert got == want


def test_greedy_match(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]]), ([], [[1.0]])], "p array<array<double>>, g array<array<double>>")
    first, second = [r["s"] for r in df.select(an.greedy_match("p", "g").alias("s")).collect()]
    assert math.isclose(first["precision"], 0.5) and math.isclose(first["recall"], 1.0) and math.isclose(first["f1"], 2 / 3)
    assert second["precision"] is None or math.isnan(second["precision"])


def test_evaluate_and_flags(spark):
    df = responses(spark, [
        ("s", True, 2.0, 0, "we cannot determine it", "gold text", ["impossible"], [("P1", "t")], [("P1", "t")]),
        ("s", True, 4.0, 1, "gold text", "gold text", [], [("P2", "t")], [("P1", "t")]),
        ("s", False, 0.0, 2, None, "gold text", [], None, None),
        ("u", True, 1.0, 3, "gold", "gold text", [], None, None),
    ])
    result = evaluation.evaluate(df)
    got = {(r["system"], r["metric"]): r["value"] for r in result.metrics.collect()}
    assert got[("s", "precision@1")] == 0.5 and got[("s", "rougeL_fmeasure")] == 0.5 and got[("s", "impossible_detection")] == 1.0
    summary = {r["system"]: r for r in result.summary.collect()}
    assert math.isclose(summary["s"]["success_rate"], 2 / 3) and summary["s"]["average_latency"] == 3.0
    assert math.isclose(summary["s"]["effectiveness"], 0.4 * 0.5 + 0.6 * 0.5)
    assert summary["u"]["effectiveness"] is None  # no retrieval part
    few = evaluation.MetricFlags(recall=False, mrr=False, rouge=False, bleu=False, impossible_detection=False, k_values=(5,))
    names = {r["metric"] for r in evaluation.evaluate(df, flags=few).metrics.collect()}
    assert names == {"precision@5", "rougeL_precision", "rougeL_recall", "rougeL_fmeasure"}


def test_effectiveness_falls_back_to_greedy(spark):
    rows = [("a", "retrieval", "precision@1", 1.0), ("a", "answer", "greedy_f1", 0.5), ("b", "answer", "rougeL_fmeasure", 0.5)]
    df = spark.createDataFrame(rows, "system string, category string, metric string, value double")
    assert [(r[0], round(r[1], 6)) for r in su.effectiveness(df, ["system"]).collect()] == [("a", 0.7)]


def test_display_names_reach_the_key_metrics(spark):
    df = spark.createDataFrame([("s", "retrieval", "precision@5", 0.1), ("s", "retrieval", "precision@1", 0.2)],
                               "system string, category string, metric string, value double")
    assert [r["metric"] for r in su.key_metrics(su.display_names(df)).collect()] == ["Precision@5"]


def test_random_property_precision_in_range(spark):
    rng = random.Random(1)
    rows = [([rng.random() < 0.4 for _ in range(rng.randint(1, 12))], rng.randint(12, 20)) for _ in range(60)]
    df = spark.createDataFrame(rows, "flags array<boolean>, n int")
    scored = df.select(*[c.alias(n) for n, c in rt.retrieval_scores(F.col("flags"), F.col("n")).items()]).collect()
    for r in scored:
        assert all(0 <= r[k] <= 1 for k in r.asDict()) and r["mrr"] >= r["precision@1"]
