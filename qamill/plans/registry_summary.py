"""Registered queries: answer metrics, robustness, summaries, comparison (M8–M15, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.operators import answers as an
from qamill.operators import catalogue as cat
from qamill.operators import summary as su
from qamill.plans import evaluation
from qamill.plans.fixtures import cte, table, view
from qamill.sources import sinks

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def qa(spark, sf):
    return view(spark, sf, "v_qa")


QA = cte("v_qa")
ROUGE_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
BLEU_TOK = (r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x85\p{{Z}}]', '', 'g'),"
            r" '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+'), lambda x: x <> '')")


def _overlap(tok: str, n: int, name: str) -> str:
    """CTEs that count clipped n-gram overlaps by explode and group."""
    gram = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
    side = lambda s: (f"SELECT conv_id, turn, {gram} AS g, count(*) AS c FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) - {n - 2})) AS i"
                      f" FROM (SELECT conv_id, turn, {tok.format(s)} AS t FROM v_qa) a) b GROUP BY ALL")
    return f"""{name} AS (SELECT p.conv_id, p.turn, sum(least(p.c, q.c)) AS hits
  FROM ({side('answer')}) p JOIN ({side('gold')}) q ON p.conv_id = q.conv_id AND p.turn = q.turn AND p.g = q.g GROUP BY ALL)"""


def _rouge_sql(n):
    return f"""{QA}, {_overlap(ROUGE_TOK, n, 'o')},
s AS (SELECT v.conv_id, v.turn, coalesce(hits, 0) AS h, greatest(len({ROUGE_TOK.format('answer')}) - {n - 1}, 0) AS np,
             greatest(len({ROUGE_TOK.format('gold')}) - {n - 1}, 0) AS ng FROM v_qa v LEFT JOIN o ON o.conv_id = v.conv_id AND o.turn = v.turn),
f AS (SELECT conv_id, turn, CASE WHEN np > 0 THEN h / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN h / ng ELSE 0 END AS r FROM s)
SELECT conv_id, turn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS fmeasure FROM f"""


def _rouge(n):
    def run(spark, sf):
        rows = an.with_counts(qa(spark, sf), bleu=False, lcs=False)
        return rows.select("conv_id", "turn", *[F.round(c, 6).alias(k) for k, c in an.rouge(n).items()])
    return run


query("rouge1", _rouge_sql(1))(_rouge(1))
query("rouge2", _rouge_sql(2))(_rouge(2))


@query("bleu4", f"""{QA}, {', '.join(_overlap(BLEU_TOK, n, f'o{n}') for n in (1, 2, 3, 4))},
s AS (SELECT v.conv_id, v.turn, len({BLEU_TOK.format('answer')}) AS np, len({BLEU_TOK.format('gold')}) AS ng,
        coalesce(o1.hits, 0) AS h1, coalesce(o2.hits, 0) AS h2, coalesce(o3.hits, 0) AS h3, coalesce(o4.hits, 0) AS h4
      FROM v_qa v {' '.join(f'LEFT JOIN o{n} ON o{n}.conv_id = v.conv_id AND o{n}.turn = v.turn' for n in (1, 2, 3, 4))})
SELECT conv_id, turn, round(CASE WHEN np = 0 OR h1 = 0 THEN 0 ELSE
  (CASE WHEN np > ng THEN 1 ELSE exp(1 - ng / np) END) * exp(({' + '.join(f'ln(CASE WHEN h{n} > 0 THEN h{n} ELSE 0.1 END / greatest(np - {n - 1}, 1))' for n in (1, 2, 3, 4))}) / 4) END, 6) AS bleu
FROM s""")
def bleu4(spark, sf):
    return an.with_counts(qa(spark, sf), rouge=False, lcs=False).select("conv_id", "turn", F.round(an.bleu(), 6).alias("bleu"))


@query("rouge_l")
def rouge_l(spark, sf):
    """LCS scores; no SQL twin for the subsequence, tests compare with brute force."""
    rows = an.with_counts(qa(spark, sf), rouge=False, bleu=False)
    return rows.select("conv_id", "turn", *[F.round(c, 6).alias(k) for k, c in an.rouge_l().items()])


@query("answer_metrics")
def answer_metrics(spark, sf):
    """All text scores of all answers, averaged per parity of the turn."""
    scored = an.answer_scores(qa(spark, sf).withColumn("system", F.concat(F.lit("sys"), (F.col("conv_id") % 3).cast("string"))))
    return rounded(an.answer_metrics(scored, ["system"]), "value")


def _evaluated(spark, sf):
    """Nested contexts and gold passages of every document, its half or whole text as answer."""
    from qamill.plans.registry_retrieval import _responses

    close = view(spark, sf, "v_close").select("doc_id", F.col("gold").alias("gold_text"), "answer")
    return _responses(spark, sf).join(close, "doc_id").withColumns({
        "success": F.col("doc_id") % 10 != 9, "latency": F.length("answer") / 1000, "question_ix": F.col("doc_id"),
        "tags": F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("impossible"))).otherwise(F.array().cast("array<string>"))})


@query("evaluate_systems")
def evaluate_systems(spark, sf):
    """The whole evaluation of three systems: retrieval, answer and robustness metrics."""
    result = evaluation.evaluate(_evaluated(spark, sf), ["system"])
    return rounded(result.metrics, "value")


@query("evaluate_summary")
def evaluate_summary(spark, sf):
    """Summary and effectiveness from the same evaluation."""
    result = evaluation.evaluate(_evaluated(spark, sf), ["system"], evaluation.MetricFlags(rouge=False, bleu=False))
    return rounded(result.summary, "success_rate", "average_latency", "effectiveness")


@query("greedy_match", """
WITH v AS (SELECT vec_id // 10 AS pair, vec_id % 2 AS side, vec_id, embedding,
             sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) ** 2))) AS norm FROM embeddings),
c AS (SELECT a.pair, a.vec_id AS p, b.vec_id AS g,
        list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / (a.norm * b.norm) AS cosine
      FROM v a JOIN v b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
x AS (SELECT pair, avg(m) AS p FROM (SELECT pair, p, max(cosine) AS m FROM c GROUP BY pair, p) q GROUP BY pair),
y AS (SELECT pair, avg(m) AS r FROM (SELECT pair, g, max(cosine) AS m FROM c GROUP BY pair, g) q GROUP BY pair)
SELECT x.pair, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM x JOIN y ON x.pair = y.pair""")
def greedy_match(spark, sf):
    side = lambda s: F.collect_list(F.when(F.col("vec_id") % 2 == s, F.col("embedding")))
    pairs = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("pair")).agg(
        side(0).alias("pred"), side(1).alias("gold"))
    out = pairs.select("pair", an.greedy_match("pred", "gold").alias("s")).select("pair", "s.*")
    return rounded(out, "precision", "recall", "f1")


def responses(spark, sf):
    answer = F.when(F.col("question_ix") % 3 == 0, "Sorry, we Cannot Determine this.").when(
        F.col("question_ix") % 3 == 1, "There is insufficient information here.").otherwise("It is forty-two.")
    tags = F.filter(F.split("tags", r"\|"), lambda x: x != "")
    return view(spark, sf, "v_responses").withColumns({"answer": answer, "tags": tags})


R = cte("v_responses")


@query("impossible_detection", f"""{R},
a AS (SELECT system, contains(concat('|', tags, '|'), '|impossible|') AS imp, question_ix % 3 <> 2 AS refused FROM v_responses WHERE success)
SELECT system, round(sum(CAST(imp AND refused AS INT)) / sum(CAST(imp AS INT)), 6) AS accuracy, CAST(sum(CAST(imp AS INT)) AS BIGINT) AS impossible_count,
  CAST(sum(CAST(NOT imp AS INT)) AS BIGINT) AS possible_count, CAST(sum(CAST(imp AND refused AS INT)) AS BIGINT) AS "right", CAST(sum(CAST(imp AND NOT refused AS INT)) AS BIGINT) AS wrong
FROM a GROUP BY system""")
def impossible_detection(spark, sf):
    return rounded(su.impossible_detection(responses(spark, sf), ["system"]), "accuracy")


SUMMARY_SQL = """count(*) AS total_questions, CAST(sum(CAST(success AS INT)) AS BIGINT) AS successful_queries,
  round(avg(CAST(success AS INT)), 6) AS success_rate, round(coalesce(avg(CASE WHEN success THEN latency END), 0), 6) AS average_latency"""


@query("evaluation_summary", f"{R} SELECT system, {SUMMARY_SQL} FROM v_responses GROUP BY system")
def evaluation_summary(spark, sf):
    return rounded(su.summary(responses(spark, sf), ["system"]), "success_rate", "average_latency")


@query("overview", f"{R} SELECT system, {SUMMARY_SQL}, strftime(max(ts), '%Y-%m-%d') AS day FROM v_responses GROUP BY system")
def overview(spark, sf):
    return rounded(su.overview(responses(spark, sf), ["system"]), "success_rate", "average_latency")


METRICS_SQL = """
SELECT system, category, metric, avg(score) AS value FROM (
  SELECT system, score, CASE WHEN question_ix % 8 < 4 THEN 'retrieval' WHEN question_ix % 8 < 7 THEN 'answer' ELSE 'robustness' END AS category,
    CASE question_ix % 8 WHEN 0 THEN 'precision@1' WHEN 1 THEN 'precision@5' WHEN 2 THEN 'recall@5' WHEN 3 THEN 'mrr'
      WHEN 4 THEN 'rougeL_fmeasure' WHEN 5 THEN 'greedy_f1' WHEN 6 THEN 'bleu' ELSE 'impossible_detection' END AS metric
  FROM {r}) m GROUP BY system, category, metric"""
MX = f"{R}, mx AS ({METRICS_SQL.format(r='v_responses')})"


def metrics(spark, sf):
    return spark.sql(METRICS_SQL, r=responses(spark, sf).select("system", "score", "question_ix"))


@query("effectiveness", f"""{MX}
SELECT system, round(0.4 * avg(CASE WHEN metric LIKE 'precision@%' THEN value END) + 0.6 * coalesce(max(CASE WHEN metric = 'rougeL_fmeasure' THEN value END), max(CASE WHEN metric = 'greedy_f1' THEN value END), 0), 6) AS effectiveness
FROM mx GROUP BY system""")
def effectiveness(spark, sf):
    return rounded(su.effectiveness(metrics(spark, sf), ["system"]), "effectiveness")


BW = f"""{R}, ok AS (SELECT * FROM v_responses WHERE success),
bw AS (SELECT * FROM (SELECT *, 'best' AS kind, row_number() OVER (PARTITION BY system ORDER BY score DESC, question_ix) AS rank FROM ok
  UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY system ORDER BY score, question_ix DESC) FROM ok) u WHERE rank <= 5)"""


@query("best_worst", f"{BW} SELECT system, kind, rank, question_ix, score FROM bw")
def best_worst(spark, sf):
    return su.best_and_worst(responses(spark, sf), ["system"]).select(
        "system", "kind", F.col("rank").cast("bigint").alias("rank"), "question_ix", "score")


@query("example_responses", f"{BW} SELECT system, kind, rank, question_ix, latency, query_type FROM bw")
def example_responses(spark, sf):
    rows = responses(spark, sf)
    picked = su.best_and_worst(rows, ["system"])
    return su.examples_to_responses(picked, rows, ["system", "question_ix"]).select(
        "system", "kind", F.col("rank").cast("bigint").alias("rank"), "question_ix", "latency", "query_type")


@query("flatten_metrics", f"""{R}
SELECT system, 'scores.average' AS metric, round(avg(score), 6) AS value FROM v_responses GROUP BY system
UNION ALL SELECT system, 'scores.best', max(score) FROM v_responses GROUP BY system
UNION ALL SELECT system, 'latency', round(avg(latency), 6) FROM v_responses GROUP BY system""")
def flatten_metrics(spark, sf):
    nested = responses(spark, sf).groupBy("system").agg(F.struct(
        F.struct(F.avg("score").alias("average"), F.max("score").alias("best")).alias("scores"),
        F.avg("latency").alias("latency")).alias("metrics"))
    return rounded(su.flatten_metrics(nested, "metrics", ["system"]), "value")


SYSTEMS = ["sys0", "sys1", "sys2"]
PIVOT = ", ".join(f"round(max(CASE WHEN system = '{s}' THEN value END), 6) AS {s}" for s in SYSTEMS)


@query("compare_systems", f"{MX} SELECT category, metric, {PIVOT} FROM mx GROUP BY category, metric")
def compare_systems(spark, sf):
    return rounded(su.compare_systems(metrics(spark, sf)), *SYSTEMS)


TYPES = list(cat.TYPE_SHARES)


@query("system_by_type", f"""{R} SELECT system, {', '.join(f"round(avg(CASE WHEN query_type = '{t}' THEN score END), 6) AS {t}" for t in TYPES)}
FROM v_responses WHERE success GROUP BY system""")
def system_by_type(spark, sf):
    out = su.system_by(su.scores_by(responses(spark, sf), "query_type"), "query_type", "average_score", TYPES)
    return rounded(out, *TYPES)


DISPLAY = f"""{MX}, dx AS (SELECT system, concat(upper(category[1]), category[2:]) AS category, CASE metric WHEN 'precision@1' THEN 'Precision@1' WHEN 'precision@5' THEN 'Precision@5'
  WHEN 'recall@5' THEN 'Recall@5' WHEN 'mrr' THEN 'MRR' WHEN 'rougeL_fmeasure' THEN 'ROUGE-rougeL_fmeasure' WHEN 'greedy_f1' THEN 'BERTScore-f1'
  WHEN 'bleu' THEN 'BLEU' ELSE 'Impossible Detection' END AS metric, round(value, 6) AS value FROM mx)"""


@query("metric_table", f"{DISPLAY} SELECT * FROM dx")
def metric_table(spark, sf):
    return rounded(su.display_names(metrics(spark, sf)), "value")


@query("key_metrics", f"""{DISPLAY} SELECT * FROM dx WHERE (category = 'Retrieval' AND metric IN ('Precision@5', 'MRR'))
 OR (category = 'Answer' AND metric IN ('ROUGE-rougeL_fmeasure', 'BERTScore-f1'))""")
def key_metrics(spark, sf):
    return rounded(su.key_metrics(su.display_names(metrics(spark, sf))), "value")


@query("filter_metrics", f"{DISPLAY} SELECT * FROM dx WHERE category = 'Answer' AND metric IN ('BLEU', 'MRR')")
def filter_metrics(spark, sf):
    return rounded(su.filter_metrics(su.display_names(metrics(spark, sf)), ["Answer"], ["BLEU", "MRR"]), "value")


def _by(column):
    return f"{R} SELECT system, {column}, round(avg(coalesce(score, 0.5)), 6) AS average_score, count(*) AS n FROM v_responses WHERE success GROUP BY system, {column}"


@query("scores_by_type", _by("query_type"))
def scores_by_type(spark, sf):
    return rounded(su.scores_by(responses(spark, sf), "query_type"), "average_score")


@query("scores_by_complexity", _by("complexity"))
def scores_by_complexity(spark, sf):
    return rounded(su.scores_by(responses(spark, sf), "complexity"), "average_score")


@query("latency_stats", f"""{R}, s AS (SELECT system, latency, row_number() OVER (PARTITION BY system ORDER BY latency) - 1 AS ix, count(*) OVER (PARTITION BY system) AS n FROM v_responses WHERE success)
SELECT system, min(latency) AS min_latency, max(latency) AS max_latency, round(avg(latency), 6) AS avg_latency, count(*) AS n,
       max(CASE WHEN ix = n // 2 THEN latency END) AS median_latency FROM s GROUP BY system""")
def latency_stats(spark, sf):
    return rounded(su.latency_stats(responses(spark, sf)), "avg_latency")


SC = "s AS (SELECT system, {0}, avg(score) AS a FROM v_responses WHERE success GROUP BY system, {0})"


@query("variation", f"""{R}, {SC.format('query_type')},
t AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY a DESC, query_type) AS hi, row_number() OVER (PARTITION BY system ORDER BY a, query_type) AS lo FROM s)
SELECT system, round(min(a), 6) AS min_score, round(max(a), 6) AS max_score, round(var_pop(a), 6) AS variance, round(max(a) - min(a), 6) AS "range",
  max(CASE WHEN hi = 1 THEN query_type END) AS best, max(CASE WHEN lo = 1 THEN query_type END) AS worst FROM t GROUP BY system HAVING count(*) > 1""")
def variation(spark, sf):
    out = su.variation(su.scores_by(responses(spark, sf), "query_type"), "query_type")
    return rounded(out, "min_score", "max_score", "variance", "range")


@query("degradation", f"""{R}, {SC.format('complexity')},
t AS (SELECT system, max(CASE WHEN complexity = 'L1' THEN a END) AS l1, max(CASE WHEN complexity = 'L3' THEN a END) AS l3 FROM s GROUP BY system)
SELECT system, round(l1, 6) AS l1_score, round(l3, 6) AS l3_score, round(l1 - l3, 6) AS absolute, round(CASE WHEN l1 > 0 THEN (l1 - l3) / l1 * 100 ELSE 0 END, 6) AS percent
FROM t WHERE l1 IS NOT NULL AND l3 IS NOT NULL""")
def degradation(spark, sf):
    out = su.degradation(su.scores_by(responses(spark, sf), "complexity"))
    return rounded(out, "l1_score", "l3_score", "absolute", "percent")


@query("search_examples", f"""{R} SELECT system, question_ix, latency FROM v_responses
WHERE query_type = 'causal' AND contains(lower(concat('Question ', CAST(question_ix AS STRING))), 'question 1') ORDER BY latency DESC, question_ix LIMIT 20""")
def search_examples(spark, sf):
    rows = responses(spark, sf).withColumn("question", F.concat(F.lit("Question "), F.col("question_ix").cast("string")))
    return su.search_examples(rows, "causal", "QUESTION 1").select("system", "question_ix", "latency")


@query("response_rows", f"""{R} SELECT concat('q_', CAST(question_ix AS STRING)) AS question_id, paper_id AS question, success, latency,
  CASE question_ix % 3 WHEN 0 THEN 'Sorry, we Cannot Determine this.' WHEN 1 THEN 'There is insufficient information here.' ELSE 'It is forty-two.' END AS answer,
  CASE WHEN question_ix % 2 = 0 THEN 'gold' ELSE '' END AS gold_answer FROM v_responses""")
def response_rows(spark, sf):
    gold = F.struct(F.when(F.col("question_ix") % 2 == 0, "gold").alias("text"))
    rows = responses(spark, sf).withColumn("question", F.struct(
        F.concat(F.lit("q_"), F.col("question_ix").cast("string")).alias("question_id"),
        F.col("paper_id").alias("question"), gold.alias("gold_answer")))
    return sinks.response_rows(rows)
