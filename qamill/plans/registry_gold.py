"""Registered queries: validation, gold answers, coverage (V*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.functions.rows import unnest
from qamill.operators import gold as go
from qamill.operators import papers as pa
from qamill.operators import validation as va
from qamill.plans.fixtures import cte, view
from qamill.plans.registry_papers import SECTIONS_SQL, STRIP, papers

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


def validated(spark, sf):
    return va.auto_validate(view(spark, sf, "v_questions"))


VAL = rf"""{cte('v_questions')},
c AS (SELECT *, length(question) >= 10 AND contains(question, '?') AND NOT regexp_matches(question, '\[[\p{{L}}\p{{N}}_]+\]') AS clarity,
        coalesce(answer, '') <> '' AND length(answer) >= 20 AS ans, query_type IS NOT NULL AND complexity IS NOT NULL AS annotation FROM v_questions),
v AS (SELECT *, CASE WHEN clarity AND ans AND annotation THEN 'approved'
   WHEN 2 + CAST(clarity AS INT) + CAST(ans AS INT) + CAST(annotation AS INT) >= 3 THEN 'needs_review' ELSE 'rejected' END AS status FROM c)"""


@query("auto_validate", VAL + r"""
SELECT doc_id, status, clarity, ans AS answer, annotation, array_to_string(list_filter([
  CASE WHEN length(question) < 10 THEN 'Question is too short' END, CASE WHEN NOT contains(question, '?') THEN 'Question does not contain a question mark' END,
  CASE WHEN regexp_matches(question, '\[[\p{L}\p{N}_]+\]') THEN 'Question contains unfilled template slots' END,
  CASE WHEN coalesce(answer, '') = '' THEN 'Missing answer' WHEN length(answer) < 20 THEN 'Answer is too short' END,
  CASE WHEN query_type IS NULL THEN 'Missing query type' END, CASE WHEN complexity IS NULL THEN 'Missing complexity level' END], lambda x: x IS NOT NULL), '; ') AS issues
FROM v""")
def auto_validate(spark, sf):
    return validated(spark, sf).select(
        "doc_id", "status", F.col("criteria")["clarity"].alias("clarity"), F.col("criteria")["answer"].alias("answer"),
        F.col("criteria")["annotation"].alias("annotation"), F.array_join("issues", "; ").alias("issues"))


@query("validation_stats", VAL + """,
d AS (SELECT 'overall' AS dimension, 'all' AS value, status FROM v UNION ALL SELECT 'query_type', query_type, status FROM v WHERE query_type IS NOT NULL
      UNION ALL SELECT 'complexity', complexity, status FROM v WHERE complexity IS NOT NULL),
s AS (SELECT dimension, value, count(*) AS total, CAST(sum(CAST(status = 'approved' AS INT)) AS BIGINT) AS approved,
   CAST(sum(CAST(status = 'needs_review' AS INT)) AS BIGINT) AS edited, CAST(sum(CAST(status = 'rejected' AS INT)) AS BIGINT) AS rejected FROM d GROUP BY dimension, value)
SELECT *, round(approved / total * 100, 6) AS approved_percent, round(edited / total * 100, 6) AS edited_percent, round(rejected / total * 100, 6) AS rejected_percent FROM s""")
def validation_stats(spark, sf):
    return rounded(va.validation_stats(validated(spark, sf)), "approved_percent", "edited_percent", "rejected_percent")


@query("criteria_stats", VAL + """,
d AS (SELECT unnest(['clarity', 'relevance', 'difficulty', 'annotation', 'answer']) AS criterion, unnest([clarity, true, true, annotation, ans]) AS ok FROM v)
SELECT criterion, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS passes, CAST(sum(CAST(NOT ok AS INT)) AS BIGINT) AS fails,
       round(avg(CAST(ok AS INT)) * 100, 6) AS pass_percent FROM d GROUP BY criterion""")
def criteria_stats(spark, sf):
    return rounded(va.criteria_stats(validated(spark, sf)), "pass_percent")


@query("coverage_sets", f"""{cte('v_questions')},
q AS (SELECT coalesce(query_type, 'unknown') AS query_type, coalesce(complexity, 'unknown') AS complexity, paper_id,
             doc_id % 4 <> 0 AS g, doc_id % 4 <> 0 AND doc_id % 3 = 0 AS v FROM v_questions),
d AS (SELECT 'overall' AS dimension, 'all' AS value, g, v FROM q UNION ALL SELECT 'query_type', query_type, g, v FROM q
      UNION ALL SELECT 'complexity', complexity, g, v FROM q UNION ALL SELECT 'paper_id', paper_id, g, v FROM q)
SELECT dimension, value, count(*) AS total, CAST(sum(CAST(g AS INT)) AS BIGINT) AS with_gold, CAST(sum(CAST(v AS INT)) AS BIGINT) AS validated FROM d GROUP BY dimension, value""")
def coverage_sets(spark, sf):
    return va.coverage(_with_flags(view(spark, sf, "v_questions")))


def _with_flags(df):
    return df.withColumns({"has_gold": F.col("doc_id") % 4 != 0, "is_validated": F.col("doc_id") % 3 == 0})


@query("build_report", VAL + """, k AS (SELECT * FROM v WHERE status <> 'rejected')
SELECT 'papers' AS measure, 'all' AS value, count(*) AS n FROM documents
UNION ALL SELECT 'generated', 'all', count(*) FROM v UNION ALL SELECT 'validated', 'all', count(*) FROM k
UNION ALL SELECT 'by_query_type', coalesce(query_type, 'unknown'), count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'by_complexity', coalesce(complexity, 'unknown'), count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'with_gold', 'all', count(*) FROM k WHERE doc_id % 4 <> 0
UNION ALL SELECT 'validated_gold', 'all', count(*) FROM k WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0""")
def build_report(spark, sf):
    rows = validated(spark, sf)
    kept = va.kept(rows)
    return va.build_report(papers(spark, sf), rows, kept, _with_flags(kept))


TERM_SQL = rf"""
w AS (SELECT doc_id, question, list_filter(list_transform(list_filter(string_split_regex(lower(question), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+'),
        lambda x: length(x) > 2 AND NOT list_contains({go.STOP_WORDS}, x)), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x85\p{{Z}}]', '', 'g')), lambda x: x <> '') AS items
      FROM v_phrases),
u AS (SELECT doc_id, x, count(*) AS n, min(i) AS first FROM (SELECT doc_id, unnest(items) AS x, unnest(range(1, len(items) + 1)) AS i FROM w) e GROUP BY doc_id, x),
best AS (SELECT doc_id, x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM u) r WHERE rn = 1),
term AS (SELECT w.doc_id, coalesce(x, array_to_string(list_filter(string_split_regex(question, '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+'), lambda y: y <> '')[1:3], ' ')) AS term
         FROM w LEFT JOIN best ON best.doc_id = w.doc_id)"""


@query("search_terms", f"{cte('v_phrases')}, {TERM_SQL} SELECT doc_id, term FROM term")
def search_terms(spark, sf):
    return view(spark, sf, "v_phrases").select("doc_id", go.search_term(F.col("question")).alias("term"))


PASSAGE_SQL = rf"""{TERM_SQL}, {SECTIONS_SQL},
sent AS (SELECT doc_id, section_ix, heading, string_split(regexp_replace(content, '([.!?])[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', '\1' || chr(30), 'g'), chr(30)) AS s FROM sec
         WHERE NOT regexp_matches(lower(heading), 'reference|bibliography|acknowledgement')),
each AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM sent),
hit AS (SELECT e.doc_id, section_ix, i, heading AS section, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS text
        FROM each e JOIN term t ON t.doc_id = e.doc_id WHERE contains(lower(s[i]), lower(term))),
uniq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY section_ix, i) AS rn FROM hit),
psg AS (SELECT doc_id, section, text, row_number() OVER (PARTITION BY doc_id ORDER BY section_ix, i) AS pos FROM uniq WHERE rn = 1)"""


def _parsed(spark, sf):
    concepts = F.array().cast("array<struct<text:string,type:string,count:bigint,examples:array<struct<section:string,context:string>>>>")
    return papers(spark, sf).select("paper_id", pa.sections(F.col("full_text")).alias("sections"), concepts.alias("concepts"))


def _asked(spark, sf):
    return view(spark, sf, "v_phrases").withColumn("paper_id", F.col("doc_id"))


@query("passages", f"{cte('v_phrases', 'v_papers')}, {PASSAGE_SQL} SELECT doc_id, pos, section, md5(text) AS text FROM psg")
def passages(spark, sf):
    asked = _asked(spark, sf).withColumn("term", go.search_term(F.col("question")))
    found = go.passages(asked.select("doc_id", "paper_id", "term"), _parsed(spark, sf))
    return unnest(found, "passages", ["doc_id"], "pos", "p").select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "p.section", F.md5("p.text").alias("text"))


@query("gold_answers", f"""{cte('v_phrases', 'v_papers')}, {PASSAGE_SQL}
SELECT v.question_id, v.doc_id, CASE WHEN v.doc_id % 4 = 0 THEN 'kept' ELSE concat('a', CAST(v.doc_id AS STRING)) END AS text, v.doc_id % 4 = 0 AS is_validated,
  CASE WHEN v.doc_id % 4 = 0 THEN '' ELSE coalesce((SELECT string_agg(concat('P', CAST(pos AS STRING), ':', md5(p.text)), '|' ORDER BY pos) FROM psg p WHERE p.doc_id = v.doc_id AND pos <= 3), '') END AS passages
FROM v_phrases v""")
def gold_answers(spark, sf):
    """A quarter of the questions come with gold and must pass unchanged."""
    had = F.when(F.col("doc_id") % 4 == 0, F.struct(
        F.lit("kept").alias("text"), F.lit(True).alias("is_validated"),
        F.array().cast("array<struct<id:string,section:string,text:string>>").alias("supporting_passages")).cast(go.GOLD_TYPE))
    asked = _asked(spark, sf).select(
        "question_id", "doc_id", "question", "paper_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer"),
        F.lit(None).cast("map<string,string>").alias("template_slots"), had.alias("gold_answer"))
    out = go.generate_gold(asked, _parsed(spark, sf))
    listed = F.array_join(F.transform("gold_answer.supporting_passages", lambda p: F.concat(p["id"], F.lit(":"), F.md5(p["text"]))), "|")
    return out.select("question_id", "doc_id", "gold_answer.text", "gold_answer.is_validated", listed.alias("passages"))


@query("placeholder_gold", f"""{cte('v_questions')}
SELECT question_id, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE concat('This is a mock gold answer for: ', question) END AS gold FROM v_questions""")
def placeholder_gold(spark, sf):
    rows = view(spark, sf, "v_questions").withColumn("gold_answer", F.when(F.col("doc_id") % 4 == 0, F.struct(
        F.lit("kept").alias("text"), F.lit(True).alias("is_validated"),
        F.array().cast("array<struct<id:string,section:string,text:string>>").alias("supporting_passages")).cast(go.GOLD_TYPE)))
    return go.placeholder_gold(rows).select("question_id", "doc_id", F.col("gold_answer.text").alias("gold"))
