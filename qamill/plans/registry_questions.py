"""Registered queries: concepts and question generation (P16, Q*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.functions.picks import draw
from qamill.operators import catalogue as cat
from qamill.operators import concepts as cp
from qamill.operators import papers as pa
from qamill.operators import questions as qu
from qamill.plans import question_set
from qamill.plans.fixtures import cte, table, view
from qamill.plans.registry_papers import SECTIONS_SQL, STRIP, papers
from qamill.session import materialise

QUERIES, ORACLES = {}, {}
SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def parsed(spark, sf):
    """Papers with front matter and sections."""
    text = F.col("full_text")
    return papers(spark, sf).select(
        F.col("paper_id").cast("string").alias("paper_id"), pa.title(text).alias("title"),
        pa.abstract(text).alias("abstract"), pa.sections(text).alias("sections"))


def full_papers(spark, sf):
    """The paper layer with concepts, written once for the steps that follow."""
    texts = papers(spark, sf).withColumn("paper_id", F.col("paper_id").cast("string"))
    return question_set.parse_papers(texts)


CONCEPT_SQL = f"""{cte('v_papers')}, {SECTIONS_SQL},
ent AS (SELECT doc_id, text, count(*) AS n FROM (
   SELECT doc_id, unnest(regexp_extract_all(content, '{cp.ENTITY}')) AS text FROM sec
   WHERE NOT regexp_matches(heading, '(?i)^References|^Bibliography|^Acknowledgements')) e GROUP BY doc_id, text HAVING count(*) >= 2),
tok AS (SELECT doc_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM (
   SELECT doc_id, regexp_extract_all(lower(string_agg(content, ' ' ORDER BY section_ix)), '[\\p{{L}}\\p{{N}}_]+') AS t FROM sec GROUP BY doc_id) a),
nxt AS (SELECT doc_id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
gram AS (SELECT doc_id, w || ' ' || w2 AS text FROM nxt WHERE w2 IS NOT NULL UNION ALL SELECT doc_id, w || ' ' || w2 || ' ' || w3 FROM nxt WHERE w3 IS NOT NULL
  UNION ALL SELECT doc_id, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM nxt WHERE w4 IS NOT NULL),
term AS (SELECT doc_id, text, count(*) AS n FROM gram WHERE length(text) > 3 GROUP BY doc_id, text HAVING count(*) >= 3),
con AS (SELECT doc_id, text, 'entity' AS type, n FROM ent UNION ALL
  SELECT doc_id, text, 'technical_term', n FROM term t WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = t.doc_id AND lower(e.text) = t.text)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY type, n DESC, text) AS rank FROM con)"""


@query("concepts", f"""{CONCEPT_SQL}
SELECT CAST(doc_id AS STRING) AS paper_id, text, type, n AS "count", rank FROM top WHERE rank <= 50""")
def concepts(spark, sf):
    return cp.concepts(materialise(parsed(spark, sf).select("paper_id", "sections"), "sections")).select(
        "paper_id", "text", "type", "count", F.col("rank").cast("bigint").alias("rank"))


@query("concept_examples")
def concept_examples(spark, sf):
    found = cp.entities(parsed(spark, sf).select("paper_id", "sections"))
    return found.select("paper_id", "text", F.posexplode("examples").alias("ix", "e")).select(
        "paper_id", "text", "ix", "e.section", F.md5("e.context").alias("context"))


SENT = rf"""list_filter(string_split(regexp_replace(content, '([.!?])[{SP}]+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '')"""


@query("question_components", rf"""{cte('v_papers')}, {SECTIONS_SQL},
h AS (SELECT *, regexp_matches(lower(heading), 'method|approach|implementation') AS m, regexp_matches(lower(heading), 'result|evaluation|experiment') AS r, {SENT} AS s FROM sec),
x AS (SELECT doc_id, section_ix, m, NOT m AND r AS r, s, content FROM h),
p AS (SELECT doc_id,
  count(DISTINCT CASE WHEN m AND regexp_matches(lower(sent), '{cat.PROCESS_CUES}') THEN sent END) AS processes,
  CAST(sum(CAST(r AND regexp_matches(lower(sent), '{cat.RESULT_CUES}') AS INT)) AS BIGINT) AS results,
  count(DISTINCT CASE WHEN r THEN nullif(regexp_extract(sent, '{cat.METRIC_NAMES}', 1), '') END) AS metrics,
  count(DISTINCT CASE WHEN regexp_matches(sent, '{cat.KEY_CUES}') THEN sent END) AS key_sentences
  FROM (SELECT *, unnest(CASE WHEN len(s) = 0 THEN [''] ELSE s END) AS sent FROM x) y GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT phrase) AS methods FROM (SELECT doc_id, unnest(CASE WHEN m THEN regexp_extract_all(content, '{cat.METHOD_PHRASE}') ELSE [] END) AS phrase FROM x) z GROUP BY doc_id)
SELECT CAST(p.doc_id AS STRING) AS paper_id, coalesce(methods, 0) AS methods, processes, results, metrics, key_sentences FROM p LEFT JOIN q ON q.doc_id = p.doc_id""")
def question_components(spark, sf):
    empty = F.array().cast("array<struct<text:string,type:string,count:bigint,examples:array<struct<section:string,context:string>>>>")
    parts = qu.components(parsed(spark, sf).withColumn("concepts", empty))
    return parts.select("paper_id", *[F.size(c).cast("bigint").alias(c) for c in (
        "methods", "processes", "results", "metrics", "key_sentences")])


@query("paper_domains", rf"""
WITH d AS (SELECT unnest({cat.DOMAINS}) AS domain, unnest(range(1, {len(cat.DOMAINS) + 1})) AS ix),
t AS (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'On Data Mining and Robotics' ELSE '' END, ' ', CASE WHEN doc_id % 3 = 1 THEN substring(text, 1, 200) ELSE '' END) AS front,
  CASE WHEN doc_id % 2 = 0 THEN concat('Uses of Physics in ', text) ELSE text END AS intro FROM documents),
f AS (SELECT doc_id, coalesce((SELECT min_by(domain, ix) FROM d WHERE contains(lower(front), domain)), (SELECT min_by(domain, ix) FROM d WHERE contains(lower(intro), domain)), '') AS domain FROM t)
SELECT CAST(doc_id AS STRING) AS paper_id, domain FROM f""")
def paper_domains(spark, sf):
    docs = table(spark, sf, "documents")
    intro = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Uses of Physics in "), "text")).otherwise(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        F.when(F.col("doc_id") % 3 == 0, "On Data Mining and Robotics").otherwise("").alias("title"),
        F.when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 200)).otherwise("").alias("abstract"),
        F.array(F.struct(F.lit("1. Introduction").alias("heading"), intro.alias("content"))).alias("sections"),
        F.array().cast("array<struct<text:string,type:string,count:bigint>>").alias("concepts"))
    return rows.select("paper_id", qu.infer_domain().alias("domain"))


def _quota_sql():
    names = list(cat.TYPE_SHARES)
    base = ", ".join(f"CAST(round_even(total * {s}, 0) AS INT) AS {t}" for t, s in cat.TYPE_SHARES.items())
    out = []
    for i, t in enumerate(names):
        larger = " + ".join(f"CAST({u} > {t} OR ({u} = {t} AND {j} < {i}) AS INT)" for j, u in enumerate(names) if u != t)
        out.append(f"{t} + CASE WHEN rest > 0 AND {sorted(names).index(t) + 1} <= rest THEN 1 WHEN rest < 0 AND {larger} < -rest THEN -1 ELSE 0 END AS {t}")
    return f"""WITH b AS (SELECT doc_id, total, {base} FROM (SELECT doc_id, CAST(n_chars % 97 AS INT) AS total FROM documents) d),
r AS (SELECT *, total - ({' + '.join(names)}) AS rest FROM b) SELECT doc_id, {', '.join(out)} FROM r"""


@query("type_quota", _quota_sql())
def type_quota(spark, sf):
    quota = table(spark, sf, "documents").select(
        "doc_id", qu.quotas((F.col("n_chars") % 97).cast("int")).alias("q"))
    return quota.select("doc_id", *[F.col("q")[t].alias(t) for t in cat.TYPE_SHARES])


PICK = "CAST(concat('0x', substring(md5(concat('42:', {0})), 1, 8)) AS BIGINT)"
ALL_Q = """
SELECT paper_id, query_type, question, {pick} AS pick FROM (
  SELECT concat('p', CAST(doc_id % 20 AS STRING)) AS paper_id, coalesce(query_type, 'open_ended') AS query_type, question, doc_id FROM v_questions
  UNION ALL SELECT paper_id, query_type, question, doc_id + 1000000000 FROM v_phrases) u"""
VALID = r"""cand AS (SELECT * FROM allq WHERE NOT regexp_matches(question, '\[[\p{L}\p{N}_]+\]') AND length(question) >= 10 AND question LIKE '%?'),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pick, paper_id, query_type) AS rn FROM cand) c WHERE rn = 1)"""
UNIQUE = f"{cte('v_questions', 'v_phrases')}, allq AS ({ALL_Q.format(pick=PICK.format('CAST(doc_id AS STRING)'))}), {VALID}"


def _unique(spark, sf):
    a = view(spark, sf, "v_questions").select(
        "paper_id", F.coalesce("query_type", F.lit("open_ended")).alias("query_type"), "question", "doc_id")
    b = view(spark, sf, "v_phrases").select("paper_id", "query_type", "question", (F.col("doc_id") + 1000000000).alias("doc_id"))
    rows = a.unionByName(b).withColumn("pick", draw(42, F.col("doc_id"))).drop("doc_id")
    return qu.distinct_questions(rows.where(qu.is_valid(F.col("question"))))


@query("valid_questions", f"{UNIQUE} SELECT paper_id, query_type, question, pick FROM uq")
def valid_questions(spark, sf):
    return _unique(spark, sf).select("paper_id", "query_type", "question", "pick")


QUOTA20 = {"factoid": 4, "definitional": 3, "procedural": 3, "comparative": 3, "causal": 2, "quantitative": 2, "open_ended": 3}
CASES = " ".join(f"WHEN '{t}' THEN {n}" for t, n in QUOTA20.items())
WEIGHTS = " ".join(f"WHEN '{t}' THEN {s}" for t, s in cat.TYPE_SHARES.items())


@query("select_questions", f"""{UNIQUE},
a AS (SELECT *, row_number() OVER (PARTITION BY paper_id, query_type ORDER BY pick, question) AS k FROM uq),
b AS (SELECT *, k <= CASE query_type {CASES} END AS chosen,
  -ln(greatest({PICK.format("concat('refill:', paper_id, ':', question)")} / 4294967296, 1e-12)) / CASE query_type {WEIGHTS} END AS race FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, CASE WHEN chosen THEN 0 ELSE race END, question) AS r FROM b)
SELECT paper_id, query_type, question FROM c WHERE r <= 20""")
def select_questions(spark, sf):
    return qu.select_questions(_unique(spark, sf), 20).select("paper_id", "query_type", "question")


@query("seed_questions", f"""{UNIQUE}
SELECT paper_id, query_type, question, true AS is_seed FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, query_type ORDER BY pick, question) AS k FROM uq) s WHERE k <= 3""")
def seed_questions(spark, sf):
    return qu.seed_questions(_unique(spark, sf)).select("paper_id", "query_type", "question", "is_seed")


def _level_sql():
    u = PICK.format("concat('complexity:', question)") + " / 4294967296"
    cases = []
    for types, weights in cat.LEVEL_WEIGHTS.items():
        level = f"CASE WHEN {u} < {weights[0][1]} THEN 'L1' WHEN {u} < {weights[0][1] + weights[1][1]} THEN 'L2' ELSE 'L3' END"
        cases.append(f"WHEN query_type IN ({', '.join(repr(t) for t in types)}) THEN {level}" if types else f"ELSE {level}")
    return f"CASE {' '.join(cases)} END"


CATS = f"""list_filter([
  CASE WHEN contains(question, 'and') AND (len(string_split(lower(question), 'what')) > 2 OR len(string_split(lower(question), 'how')) > 2) THEN 'multi_part' END,
  CASE WHEN regexp_matches(lower(question), '{'|'.join(cat.TEMPORAL_WORDS)}') THEN 'temporal' END,
  CASE WHEN regexp_matches(lower(question), '{'|'.join(cat.AMBIGUOUS_WORDS)}') AND {PICK.format("concat('ambiguous:', question)")} / 4294967296 < 0.7 THEN 'ambiguous' END,
  CASE WHEN {PICK.format("concat('impossible:', question)")} / 4294967296 < 0.05 THEN 'impossible' END], lambda x: x IS NOT NULL)"""


@query("annotate_questions", f"""{UNIQUE}, an AS (SELECT *, {_level_sql()} AS complexity, {CATS} AS cats FROM uq)
SELECT concat('q_', substring(md5(question), 1, 12)) AS question_id, complexity, array_to_string(cats, '|') AS special_categories,
  CASE WHEN list_contains(cats, 'impossible') THEN '{cat.NOT_POSSIBLE}' ELSE '{cat.PLACEHOLDER}' END AS answer FROM an""")
def annotate_questions(spark, sf):
    return qu.annotate(_unique(spark, sf)).select(
        "question_id", "complexity", F.array_join("special_categories", "|").alias("special_categories"), "answer")


def _gap_sql():
    dims = {"query_type": cat.TYPE_SHARES, "complexity": cat.LEVEL_SHARES, "special_category": cat.SPECIAL_SHARES}
    rows = ", ".join(f"('{d}', '{v}', {s})" for d, shares in dims.items() for v, s in shares.items())
    return f"""{UNIQUE}, an AS (SELECT *, {_level_sql()} AS complexity, {CATS} AS cats FROM uq),
v AS (SELECT 'query_type' AS dimension, query_type AS value FROM an UNION ALL SELECT 'complexity', complexity FROM an UNION ALL SELECT 'special_category', unnest(cats) FROM an),
c AS (SELECT dimension, value, count(*) AS n FROM v GROUP BY ALL), t(dimension, value, target) AS (VALUES {rows}), z AS (SELECT count(*) AS total FROM an)
SELECT t.dimension, t.value, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS observed, CAST(target AS DOUBLE) AS target, round(coalesce(n, 0) / total - target, 6) AS gap
FROM t CROSS JOIN z LEFT JOIN c ON c.dimension = t.dimension AND c.value = t.value"""


@query("distribution_gap", _gap_sql())
def distribution_gap(spark, sf):
    return rounded(qu.distribution_gap(qu.annotate(_unique(spark, sf))), "observed", "gap")


TERM3 = "split_part(text, ' ', 5)"


@query("term_context", rf"""
WITH a AS (SELECT doc_id, text, term, instr(text, term) - 1 AS pos FROM (SELECT doc_id, text, {TERM3} AS term FROM documents) d WHERE term <> ''),
b AS (SELECT *, greatest(pos - 200, 0) AS low, least(pos + length(term) + 200, length(text)) AS high FROM a),
c AS (SELECT *, length(regexp_replace(substring(text, 1, low + 1), '[^.!?]*\z', '')) AS lead, length(regexp_extract(substring(text, high + 1), '^[^.!?]*')) AS more FROM b),
d AS (SELECT *, CASE WHEN lead > 1 THEN lead ELSE 0 END AS s, least(high + more + 1, length(text)) AS e FROM c)
SELECT doc_id, md5(regexp_replace(substring(text, s + 1, e - s), {STRIP})) AS context FROM d""")
def term_context(spark, sf):
    rows = table(spark, sf, "documents").withColumn("term", F.split_part("text", F.lit(" "), F.lit(5))).where("term <> ''")
    return rows.select("doc_id", F.md5(qu.around(F.col("text"), F.col("term"))).alias("context"))


@query("shorten_context", rf"""
WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])[{SP}]+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '') AS items FROM documents),
k AS (SELECT *, len(list_filter(range(1, len(items) + 1), lambda k: coalesce(list_sum(list_transform(items[1:k - 1], lambda x: length(x) + 1)), 0) + length(items[k]) <= 500)) AS n FROM s)
SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(array_to_string(items[1:n], ' '), {STRIP}) END) AS context FROM k""")
def shorten_context(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(qu.shorten(F.col("text"))).alias("context"))


@query("definitions")
def definitions(spark, sf):
    """The definition lookup for the first keyword of every paper."""
    text = F.col("full_text")
    rows = papers(spark, sf).select(
        "paper_id", pa.sections(text).alias("sections"), F.get(pa.keywords(text), F.lit(0)).alias("term"))
    return rows.select("paper_id", F.md5(qu.definition(F.col("term"), F.col("sections"))).alias("definition"))


@query("comparisons")
def comparisons(spark, sf):
    """The comparison lookup for two words of every document in its own text."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("a"), F.split_part("text", F.lit(" "), F.lit(30)).alias("b"),
        F.array(F.struct(F.lit("Text").alias("heading"), F.col("text").alias("content"))).alias("sections"))
    return docs.select("doc_id", F.md5(qu.comparison(F.col("a"), F.col("b"), F.col("sections"))).alias("comparison"))


@query("fill_templates")
def fill_templates(spark, sf):
    """Every template against every paper, before validity."""
    return qu.instantiate(qu.components(full_papers(spark, sf))).select(
        "paper_id", "query_type", "template_ix", "variant", "question",
        F.to_json("template_slots").alias("slots"))


@query("generate_questions")
def generate_questions(spark, sf):
    """The whole step: concepts, filling, selection, annotation and contexts."""
    return qu.generate(full_papers(spark, sf), store=materialise).select(
        "paper_id", "question_id", "question", "query_type", "complexity",
        F.array_join("special_categories", "|").alias("special_categories"), F.size("contexts").alias("n_contexts"))


@query("question_set_report")
def question_set_report(spark, sf):
    """Papers to questions to validation to gold, and the counts of every layer."""
    texts = papers(spark, sf).withColumn("paper_id", F.col("paper_id").cast("string"))
    return question_set.report(question_set.build(texts, n=10))
