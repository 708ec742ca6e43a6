"""Registered queries: bias statistics (B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.operators import bias as bi
from qamill.operators import catalogue as cat
from qamill.plans.fixtures import cte, view

QUERIES, ORACLES = {}, {}
FIELDS = ["query_type", "complexity", "paper_id"]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def responses(spark, sf):
    tags = F.filter(F.split("tags", r"\|"), lambda x: x != "")
    return view(spark, sf, "v_responses").withColumn("special_categories", tags)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


LONG_SQL = """
SELECT system, success, score, 'query_type' AS field, query_type AS value FROM v_responses
UNION ALL SELECT system, success, score, 'complexity', complexity FROM v_responses
UNION ALL SELECT system, success, score, 'paper_id', paper_id FROM v_responses
"""
TAGS_SQL = """
UNION ALL SELECT system, success, score, 'special_categories',
  unnest(CASE WHEN tags = '' THEN ['none'] ELSE string_split(tags, '|') END) FROM v_responses
"""
R = cte("v_responses")


@query("distribution", f"""{R}, long AS ({LONG_SQL} {TAGS_SQL}),
c AS (SELECT field, value, count(*) AS n FROM long GROUP BY field, value)
SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 6) AS share FROM c""")
def distribution(spark, sf):
    return rounded(bi.distribution(responses(spark, sf), FIELDS, ["special_categories"]), "share")


QD = f"""{cte('v_questions')}, long AS (
  SELECT 'query_type' AS field, coalesce(query_type, 'unknown') AS value FROM v_questions
  UNION ALL SELECT 'complexity', coalesce(complexity, 'unknown') FROM v_questions
  UNION ALL SELECT 'lead', split_part(question, ' ', 1) FROM v_questions),
c AS (SELECT field, value, count(*) AS n FROM long GROUP BY field, value),
d AS (SELECT field, value, n, n / sum(n) OVER (PARTITION BY field) AS share FROM c),
e AS (SELECT field, CASE WHEN count(*) <= 1 THEN 1.0 ELSE -sum(share * ln(share)) / ln(count(*)) END AS evenness,
             count(*) AS categories FROM d GROUP BY field)"""


def _questions(spark, sf):
    return view(spark, sf, "v_questions").withColumn("lead", F.split_part("question", F.lit(" "), F.lit(1)))


@query("evenness", f"{QD} SELECT field, round(evenness, 6) AS evenness, categories FROM e")
def evenness(spark, sf):
    return rounded(bi.evenness(bi.distribution(_questions(spark, sf), ["query_type", "complexity", "lead"])), "evenness")


@query("uneven_flags", f"""{QD}, top AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rn FROM d)
SELECT e.field, round(evenness, 6) AS evenness, value AS dominant_value, round(share, 6) AS dominant_share
FROM e JOIN top ON e.field = top.field AND rn = 1 WHERE evenness < 0.95""")
def uneven_flags(spark, sf):
    """The flag rule at 0.95, so that the even test data raises some."""
    dist = bi.distribution(_questions(spark, sf), ["query_type", "complexity", "lead"])
    return rounded(bi.uneven_flags(dist, threshold=0.95), "evenness", "dominant_share")


NAMES = [*cat.TYPE_SHARES, "hypothetical"]  # the taxonomy and a type that no response has


@query("contingency", f"""{R},
a AS (SELECT DISTINCT paper_id AS value1 FROM v_responses), b AS (SELECT unnest({NAMES!r}) AS value2),
c AS (SELECT paper_id AS value1, query_type AS value2, count(*) AS n FROM v_responses GROUP BY ALL)
SELECT coalesce(c.value1, a.value1) AS value1, coalesce(c.value2, b.value2) AS value2, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (a CROSS JOIN b) FULL JOIN c ON c.value1 = a.value1 AND c.value2 = b.value2""")
def contingency(spark, sf):
    return bi.contingency(responses(spark, sf), "paper_id", "query_type", NAMES)


def _v_sql(a, b, src):
    return f"""
SELECT '{a}_{b}' AS pair, n, n_rows, n_cols, chi2, CASE WHEN least(n_rows, n_cols) <= 1 THEN 0 ELSE sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))) END AS cramers_v
FROM (SELECT max(t) AS n, count(DISTINCT v1) AS n_rows, count(DISTINCT v2) AS n_cols,
        CASE WHEN least(count(DISTINCT v1), count(DISTINCT v2)) <= 1 THEN 0
             WHEN count(DISTINCT v1) = 2 AND count(DISTINCT v2) = 2
             THEN sum((abs(o - r * c / t) - least(0.5, abs(o - r * c / t))) ** 2 / (r * c / t))
             ELSE sum((o - r * c / t) ** 2 / (r * c / t)) END AS chi2
      FROM (SELECT x.v1, y.v2, r, c, t, coalesce(o, 0) AS o
            FROM (SELECT coalesce({a}, 'unknown') AS v1, count(*) AS r FROM {src} GROUP BY 1) x
            CROSS JOIN (SELECT coalesce({b}, 'unknown') AS v2, count(*) AS c FROM {src} GROUP BY 1) y
            CROSS JOIN (SELECT count(*) AS t FROM {src}) z
            LEFT JOIN (SELECT coalesce({a}, 'unknown') AS v1, coalesce({b}, 'unknown') AS v2, count(*) AS o FROM {src} GROUP BY 1, 2) w
              ON w.v1 = x.v1 AND w.v2 = y.v2) cells) s"""


PAIRS = [("query_type", "complexity"), ("query_type", "flag"), ("query_type", "half"),
         ("complexity", "flag"), ("complexity", "half"), ("flag", "half")]


@query("cramers_v", f"""{cte('v_questions')},
q AS (SELECT query_type, complexity, CASE WHEN question LIKE '%?' THEN 'mark' ELSE 'none' END AS flag,
             CASE WHEN length(answer) > 30 THEN 'long' ELSE 'short' END AS half FROM v_questions)
SELECT pair, n, n_rows, n_cols, round(chi2, 5) AS chi2, round(cramers_v, 6) AS cramers_v, cramers_v > 0.5 AS strong
FROM ({' UNION ALL '.join(_v_sql(a, b, 'q') for a, b in PAIRS)}) u""")
def cramers_v(spark, sf):
    q = view(spark, sf, "v_questions").withColumns({
        "flag": F.when(F.col("question").like("%?"), "mark").otherwise("none"),
        "half": F.when(F.length("answer") > 30, "long").otherwise("short"),
    })
    out = bi.field_pairs(q, ["query_type", "complexity", "flag", "half"])
    return rounded(out, "cramers_v").withColumn("chi2", F.round("chi2", 5))


STATS_SQL = ", ".join(
    f"round(avg({c}), 6) AS mean_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, "
    f"median({c}) AS median_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in ("chars", "words"))
SIZED = r"""sized AS (SELECT coalesce(query_type, 'unknown') AS query_type, length(question) AS chars,
  len(list_filter(string_split_regex(question, '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda x: x <> '')) AS words FROM v_questions)"""


def _text_stats(spark, sf, by):
    q = view(spark, sf, "v_questions").withColumn("query_type", F.coalesce("query_type", F.lit("unknown")))
    return rounded(bi.text_stats(q, by=by), "mean_chars", "mean_words", "std_chars", "std_words")


@query("text_stats", f"{cte('v_questions')}, {SIZED} SELECT count(*) AS n, {STATS_SQL} FROM sized")
def text_stats(spark, sf):
    return _text_stats(spark, sf, [])


@query("text_stats_by_type", f"{cte('v_questions')}, {SIZED} SELECT query_type, count(*) AS n, {STATS_SQL} FROM sized GROUP BY query_type")
def text_stats_by_type(spark, sf):
    return _text_stats(spark, sf, ["query_type"])


@query("short_text_flags", f"""{cte('v_questions')}, {SIZED}
SELECT issue, value FROM (SELECT 'too_short_questions' AS issue, round(avg(chars), 6) AS value, avg(chars) < 20 AS bad FROM sized
  UNION ALL SELECT 'too_few_words', round(avg(words), 6), avg(words) < 5 FROM sized) s WHERE bad""")
def short_text_flags(spark, sf):
    return rounded(bi.short_text_flags(bi.text_stats(view(spark, sf, "v_questions"))), "value")


@query("response_scores", rf"""{cte('v_qa')},
s AS (SELECT conv_id, turn, gold, answer, CASE WHEN turn % 3 = 0 THEN turn / 10 END AS score,
             CASE WHEN conv_id % 5 = 0 THEN 0.25 END AS rouge FROM v_qa),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(gold), '[\p{{L}}\p{{N}}_]+')) AS a,
             list_distinct(regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}_]+')) AS b FROM s)
SELECT conv_id, turn, round(coalesce(score, rouge, CASE WHEN gold <> '' AND answer <> '' THEN
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END END, 0.5), 6) AS score
FROM t""")
def response_scores(spark, sf):
    q = view(spark, sf, "v_qa")
    given = F.when(F.col("turn") % 3 == 0, F.col("turn") / 10)
    rouge = F.when(F.col("conv_id") % 5 == 0, F.lit(0.25))
    score = bi.response_score(given, F.lit(None).cast("double"), rouge, F.col("gold"), F.col("answer"))
    return q.select("conv_id", "turn", F.round(score, 6).alias("score"))


G = f"""{R}, long AS ({LONG_SQL} {TAGS_SQL}),
g AS (SELECT system, field, value, count(*) AS n, avg(score) AS mean, median(score) AS median, min(score) AS min,
             max(score) AS max, stddev_pop(score) AS std, var_pop(score) AS vp
      FROM long WHERE success GROUP BY system, field, value)"""


@query("scores_by_field", f"""{G}
SELECT system, field, value, n, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round(std, 6) AS std FROM g""")
def scores_by_field(spark, sf):
    out = bi.scores_by_field(responses(spark, sf), FIELDS, ["special_categories"])
    return rounded(out, "mean", "median", "std")


def _groups(spark, sf):
    return bi.scores_by_field(responses(spark, sf), FIELDS, median=False)


ANOVA = f"""{G}, gg AS (SELECT * FROM g WHERE field <> 'special_categories'),
t AS (SELECT system, field, sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum(n * vp) AS ssw FROM gg GROUP BY system, field),
a AS (SELECT gg.system, gg.field, max(nn) AS n, max(k) AS k,
             (sum(gg.n * (mean - grand) ** 2) / (max(k) - 1)) / (max(ssw) / (max(nn) - max(k))) AS f_value
      FROM gg JOIN t ON gg.system = t.system AND gg.field = t.field GROUP BY gg.system, gg.field)"""


@query("anova_f", f"{ANOVA} SELECT system, field, CAST(n AS BIGINT) AS n, k, round(f_value, 5) AS f_value FROM a")
def anova_f(spark, sf):
    return bi.anova(_groups(spark, sf)).select("system", "field", "n", "k", F.round("f_value", 5).alias("f_value"))


@query("anova_p")
def anova_p(spark, sf):
    """F, p and significance; DuckDB has no F distribution, tests hold published values."""
    return rounded(bi.anova(_groups(spark, sf)), "f_value", "p_value")


@query("disparity")
def disparity(spark, sf):
    groups = _groups(spark, sf)
    return rounded(bi.disparities(groups, bi.anova(groups)), "p_value", "gap")


@query("disparity_ends", f"""{G},
e AS (SELECT *, row_number() OVER (PARTITION BY system, field ORDER BY mean DESC, value) AS hi,
             row_number() OVER (PARTITION BY system, field ORDER BY mean, value) AS lo FROM g WHERE field <> 'special_categories')
SELECT system, field, max(CASE WHEN hi = 1 THEN value END) AS best, max(CASE WHEN lo = 1 THEN value END) AS worst,
       round(max(mean) - min(mean), 6) AS gap FROM e GROUP BY system, field""")
def disparity_ends(spark, sf):
    """Best and worst value with every test taken as significant."""
    groups = _groups(spark, sf)
    every = bi.anova(groups).withColumn("significant", F.lit(True))
    return rounded(bi.disparities(groups, every).drop("p_value"), "gap")


GS = f"""{R}, long AS ({LONG_SQL}), tot AS (SELECT system, count(*) AS total FROM v_responses GROUP BY system),
gs AS (SELECT l.system, field, value, count(*) AS n, count(*) / max(total) AS share, avg(CAST(success AS INT)) AS success_rate,
              coalesce(avg(CASE WHEN success THEN score END), 0) AS score
       FROM long l JOIN tot ON l.system = tot.system GROUP BY l.system, field, value)"""


@query("group_stats", f"""{GS} SELECT system, field, value, n, round(share, 6) AS share, round(success_rate, 6) AS success_rate, round(score, 6) AS score FROM gs""")
def group_stats(spark, sf):
    return rounded(bi.group_stats(responses(spark, sf), FIELDS), "share", "success_rate", "score")


@query("group_outliers", f"""{GS},
s AS (SELECT *, avg(score) OVER (PARTITION BY system, field) AS m, stddev_samp(score) OVER (PARTITION BY system, field) AS sd FROM gs)
SELECT system, field, value, round(score, 6) AS score, round(score - m, 6) AS difference, round((score - m) / sd, 6) AS deviations
FROM s WHERE sd > 0 AND abs(score - m) > 2 * sd""")
def group_outliers(spark, sf):
    groups = bi.group_stats(responses(spark, sf), FIELDS)
    return rounded(bi.group_outliers(groups), "score", "difference", "deviations")
