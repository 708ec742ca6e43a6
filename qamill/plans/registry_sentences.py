"""Registered queries: questions, validation and gold over every sentence of every text (Q*, V*, G*).

Each sentence of each document becomes a question on its document's paper, so the operators work on
whole texts: as many questions as there are sentences, long ones and short ones, with their terms
searched in the whole paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.functions.rows import unnest
from qamill.operators import gold as go
from qamill.operators import papers as pa
from qamill.operators import validation as va
from qamill.plans.fixtures import cte, table
from qamill.plans.registry_papers import SECTIONS_SQL, papers

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"
STARTS = ["What is ", "How does ", "Why is ", "", "Which [slot] of "]
TYPES = ["factoid", "causal", "procedural", None]


def chosen(items: list[str | None]) -> Column:
    """An item by the number of the sentence."""
    return F.get(F.array(*[F.lit(x) for x in items]), (F.col("ix") % len(items)).cast("int"))


def asked(spark, sf) -> DataFrame:
    """doc_id, ix, question, answer, query_type, complexity: one row per sentence."""
    rows = unnest(table(spark, sf, "documents"), tx.sentences(F.col("text")), ["doc_id"], "ix", "answer")
    bare = F.regexp_replace("answer", r"[.!?]+\z", "")
    mark = F.when(F.col("ix") % 7 == 0, "").otherwise("?")
    return rows.withColumns({
        "question": F.concat(chosen(STARTS), bare, mark), "query_type": chosen(TYPES),
        "complexity": F.concat(F.lit("L"), (1 + F.col("ix") % 3).cast("string"))})


def _case(items: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(items))
    return f"CASE ix % {len(items)} {arms} END"


ASKED_SQL = rf"""
cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{SP}]+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '') AS s FROM documents),
each_sentence AS (SELECT doc_id, unnest(range(0, len(s))) AS ix, unnest(s) AS answer FROM cut),
asked AS (SELECT *, concat({_case(STARTS)}, regexp_replace(answer, '[.!?]+\z', ''), CASE WHEN ix % 7 = 0 THEN '' ELSE '?' END) AS question,
            {_case(TYPES)} AS query_type, concat('L', CAST(1 + ix % 3 AS STRING)) AS complexity FROM each_sentence)"""

VALID_SQL = rf"""WITH {ASKED_SQL},
c AS (SELECT *, length(question) >= 10 AND contains(question, '?') AND NOT regexp_matches(question, '\[[\p{{L}}\p{{N}}_]+\]') AS clarity,
        length(answer) >= 20 AS ans, query_type IS NOT NULL AS annotation FROM asked),
v AS (SELECT *, CASE WHEN clarity AND ans AND annotation THEN 'approved'
   WHEN 2 + CAST(clarity AS INT) + CAST(ans AS INT) + CAST(annotation AS INT) >= 3 THEN 'needs_review' ELSE 'rejected' END AS status FROM c)"""


@query("sentence_validation", VALID_SQL + """
SELECT doc_id, ix, status, clarity, ans AS answer, annotation FROM v""")
def sentence_validation(spark, sf):
    """V1, V2 on every sentence."""
    flag = lambda name: F.col("criteria")[name].alias(name)
    return va.auto_validate(asked(spark, sf)).select(
        "doc_id", F.col("ix").cast("bigint").alias("ix"), "status", flag("clarity"), flag("answer"), flag("annotation"))


@query("sentence_validation_stats", VALID_SQL + """,
d AS (SELECT 'overall' AS dimension, 'all' AS value, status FROM v UNION ALL SELECT 'query_type', query_type, status FROM v WHERE query_type IS NOT NULL
      UNION ALL SELECT 'complexity', complexity, status FROM v)
SELECT dimension, value, count(*) AS total, CAST(sum(CAST(status = 'approved' AS INT)) AS BIGINT) AS approved,
   CAST(sum(CAST(status = 'needs_review' AS INT)) AS BIGINT) AS edited, CAST(sum(CAST(status = 'rejected' AS INT)) AS BIGINT) AS rejected FROM d GROUP BY dimension, value""")
def sentence_validation_stats(spark, sf):
    """V3 on every sentence."""
    stats = va.validation_stats(va.auto_validate(asked(spark, sf)))
    return stats.select("dimension", "value", "total", "approved", "edited", "rejected")


TERMS_SQL = rf"""
w AS (SELECT doc_id, ix, question, list_filter(list_transform(list_filter(string_split_regex(lower(question), '[{SP}]+'),
        lambda x: length(x) > 2 AND NOT list_contains({go.STOP_WORDS}, x)), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_{SP}]', '', 'g')), lambda x: x <> '') AS items
      FROM asked),
u AS (SELECT doc_id, ix, x, count(*) AS n, min(i) AS first FROM (SELECT doc_id, ix, unnest(items) AS x, unnest(range(1, len(items) + 1)) AS i FROM w) e GROUP BY ALL),
best AS (SELECT doc_id, ix, arg_max(x, n * 1000000000 - first) AS x FROM u GROUP BY doc_id, ix),
term AS (SELECT w.doc_id, w.ix, coalesce(x, array_to_string(list_filter(string_split_regex(question, '[{SP}]+'), lambda y: y <> '')[1:3], ' ')) AS term
         FROM w LEFT JOIN best ON best.doc_id = w.doc_id AND best.ix = w.ix)"""


@query("sentence_terms", f"WITH {ASKED_SQL}, {TERMS_SQL} SELECT doc_id, ix, term FROM term")
def sentence_terms(spark, sf):
    """G1 on every sentence."""
    return asked(spark, sf).select(
        "doc_id", F.col("ix").cast("bigint").alias("ix"), go.search_term(F.col("question")).alias("term"))


FOUND_SQL = rf"""{TERMS_SQL}, {SECTIONS_SQL.replace('cut AS', 'headed AS', 1).replace('FROM cut', 'FROM headed')},
sent AS (SELECT doc_id, section_ix, heading, string_split(regexp_replace(content, '([.!?])[{SP}]+', '\1' || chr(30), 'g'), chr(30)) AS s FROM sec
         WHERE NOT regexp_matches(lower(heading), '{"|".join(go.NO_EVIDENCE)}')),
place AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM sent),
line AS (SELECT doc_id, section_ix, i, heading, lower(s[i]) AS low, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS text FROM place),
hit AS (SELECT l.doc_id, t.term, section_ix, i, heading, text FROM line l
        JOIN (SELECT DISTINCT doc_id, lower(term) AS term FROM term) t ON t.doc_id = l.doc_id AND contains(low, t.term)),
uniq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term, text ORDER BY section_ix, i) AS rn FROM hit),
psg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY section_ix, i) AS pos FROM uniq WHERE rn = 1)"""


def _with_paper(spark, sf) -> tuple[DataFrame, DataFrame]:
    concepts = F.array().cast("array<struct<text:string,type:string,count:bigint,examples:array<struct<section:string,context:string>>>>")
    parsed = papers(spark, sf).select("paper_id", pa.sections(F.col("full_text")).alias("sections"), concepts.alias("concepts"))
    return asked(spark, sf).withColumn("paper_id", F.col("doc_id")), parsed


@query("sentence_passages", f"""{cte('v_papers')}, {ASKED_SQL}, {FOUND_SQL},
by_term AS (SELECT doc_id, term, count(*) AS n, md5(string_agg(concat(heading, ':', text), '|' ORDER BY pos)) AS passages FROM psg GROUP BY doc_id, term)
SELECT t.doc_id, t.ix, coalesce(n, 0) AS n, coalesce(passages, md5('')) AS passages FROM term t LEFT JOIN by_term b ON b.doc_id = t.doc_id AND b.term = lower(t.term)""")
def sentence_passages(spark, sf):
    """All passages of the paper for the term of every sentence."""
    questions, parsed = _with_paper(spark, sf)
    found = go.passages(questions.select("doc_id", "ix", "paper_id", go.search_term(F.col("question")).alias("term")), parsed)
    listed = F.array_join(F.transform("passages", lambda p: F.concat(p["section"], F.lit(":"), p["text"])), "|")
    return found.select("doc_id", F.col("ix").cast("bigint").alias("ix"), F.size("passages").cast("bigint").alias("n"),
                        F.md5(listed).alias("passages"))


@query("sentence_gold", f"""{cte('v_papers')}, {ASKED_SQL}, {FOUND_SQL},
by_term AS (SELECT doc_id, term, string_agg(concat('P', CAST(pos AS STRING), ':', md5(text)), '|' ORDER BY pos) AS passages FROM psg WHERE pos <= 3 GROUP BY doc_id, term)
SELECT a.doc_id, a.ix, md5(answer) AS text, coalesce(passages, '') AS passages FROM asked a JOIN term t ON t.doc_id = a.doc_id AND t.ix = a.ix
LEFT JOIN by_term b ON b.doc_id = a.doc_id AND b.term = lower(t.term)""")
def sentence_gold(spark, sf):
    """Gold with at most three passages for every sentence."""
    questions, parsed = _with_paper(spark, sf)
    rows = questions.withColumns({
        "template_slots": F.lit(None).cast("map<string,string>"), "gold_answer": F.lit(None).cast(go.GOLD_TYPE)})
    listed = F.array_join(F.transform("gold_answer.supporting_passages", lambda p: F.concat(p["id"], F.lit(":"), F.md5(p["text"]))), "|")
    return go.generate_gold(rows, parsed).select(
        "doc_id", F.col("ix").cast("bigint").alias("ix"), F.md5("gold_answer.text").alias("text"), listed.alias("passages"))
