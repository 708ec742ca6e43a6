"""Registered queries: adversarial variants (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.operators import adversarial as ad
from qamill.operators import bias as bi
from qamill.plans.fixtures import cte, view
from qamill.plans.registry_bias import responses

QUERIES, ORACLES = {}, {}
SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def asked(spark, sf):
    return view(spark, sf, "v_phrases")


V = cte("v_phrases")
lit = lambda s: "'" + s.replace("'", "''") + "'"
WORDS = f"list_filter(string_split_regex(question, '[{SP}]+'), lambda x: x <> '')"


def pick(options, key="question"):
    listed = ", ".join(lit(o) for o in options)
    return f"([{listed}])[CAST('0x' || substring(md5({key}), 1, 8) AS BIGINT) % {len(options)} + 1]"


def stem(drop):
    return rf"regexp_replace(substring(question, {drop + 1}), '\?+\z', '')"


def without(patterns):
    return " ".join(f"WHEN regexp_matches(question, '{p}') THEN replace(question, regexp_extract(question, '{p}'), '')" for p in patterns)


MODIFIED = " ".join(f"WHEN starts_with(question, '{a}') THEN replace(question, '{a}', '{b}')" for a, b in ad.MODIFIERS)
aside = lambda options: f"concat({pick(options)}, lower(substring(question, 1, 1)), substring(question, 2))"
SUBS = ", ".join(f"CASE WHEN contains(question, '{a}') THEN replace(question, '{a}', '{b}') END" for a, b in ad.SUBSTITUTIONS)
PARA = rf"""w AS (SELECT doc_id, question_id, question, special, list_filter([CASE WHEN starts_with(question, 'What is') THEN concat('Can you explain what ', {stem(8)}, ' is?') END,
   {SUBS}, CASE WHEN regexp_matches(question, 'What does ([^?]+) do\?') THEN concat('What is done by ', regexp_extract(question, 'What does ([^?]+) do\?', 1), '?') END], lambda x: x IS NOT NULL) AS made FROM v_phrases),
u AS (SELECT doc_id, question_id, question, special, unnest(CASE WHEN len(made) > 0 THEN made ELSE [concat('Please tell me: ', question)] END) AS p, unnest(range(1, 1 + greatest(len(made), 1))) AS i FROM w),
d AS (SELECT doc_id, question_id, special, p, min(i) AS i FROM u WHERE p <> question GROUP BY ALL),
para AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS variant FROM d)"""
AMBIG = f"""CASE {without(ad.SPECIFIC)} {MODIFIED} WHEN len({WORDS}) > 4 THEN array_to_string(list_concat(list_append(({WORDS})[1:len({WORDS}) // 2], {pick(ad.PRONOUNS)}), ({WORDS})[len({WORDS}) // 2 + 2:]), ' ') ELSE question END"""


@query("adversarial_paraphrase", f"""{V}, {PARA} SELECT doc_id, concat(question_id, '_para_', CAST(variant AS STRING)) AS question_id, p AS question, variant FROM para""")
def adversarial_paraphrase(spark, sf):
    return ad.expand(asked(spark, sf).withColumn("special_categories", F.array().cast("array<string>")), ("paraphrase",)).select(
        "doc_id", "question_id", "question", F.col("adversarial.variant").cast("bigint").alias("variant"))


@query("adversarial_expand", f"""{V}, {PARA},
o AS (SELECT doc_id, concat(question_id, '_para_', CAST(variant AS STRING)) AS question_id, p AS question, 'paraphrase' AS technique, special FROM para
 UNION ALL SELECT doc_id, concat(question_id, '_ambig'), a, 'ambiguity', CASE WHEN contains(special, 'ambiguous') THEN special WHEN special = '' THEN 'ambiguous' ELSE concat(special, '|ambiguous') END
   FROM (SELECT *, {AMBIG} AS a FROM v_phrases) x WHERE a <> question AND a <> ''
 UNION ALL SELECT doc_id, concat(question_id, '_irrel'), {aside(ad.ASIDES)}, 'irrelevant_context', special FROM v_phrases)
SELECT doc_id, question_id, question, technique, special FROM o""")
def adversarial_expand(spark, sf):
    rows = asked(spark, sf).withColumn("special_categories", F.filter(F.split("special", r"\|"), lambda x: x != ""))
    return ad.expand(rows.drop("special")).select(
        "doc_id", "question_id", "question", "adversarial.technique", F.array_join("special_categories", "|").alias("special"))


RULES = {
    "targeted_paraphrase": (ad.targeted_paraphrase, "CASE " + " ".join(
        f"WHEN starts_with(question, '{p}') THEN concat({lit(lead)}, {stem(drop)}, '{end}')" for p, drop, lead, end in ad.TARGETED_PREFIXES
    ) + f" ELSE concat({pick(ad.LEAD_INS)}, ' ', question) END"),
    "targeted_irrelevant": (ad.targeted_irrelevant, aside(ad.TARGETED_ASIDES)),
    "impossible_questions": (ad.impossible, f"""coalesce(CASE WHEN NOT contains(lower(question), 'in the future') AND NOT contains(lower(question), 'will') THEN
  CASE WHEN starts_with(question, 'What') THEN replace(question, 'What', 'What will') WHEN starts_with(question, 'How') THEN replace(question, 'How', 'How will')
       WHEN len({WORDS}) > 3 THEN concat({pick(ad.IMPOSSIBLE_PREFIXES)}, array_to_string(({WORDS})[2:3], ' '), '?') END END,
  CASE WHEN regexp_matches(question, 'paper|study|research') THEN replace(question, '?', ' that was deliberately excluded from the paper?') ELSE replace(question, '?', ' according to unpublished data?') END)"""),
}
for _name, (_rule, _sql) in RULES.items():
    query(_name, f"{V} SELECT doc_id, {_sql} AS question FROM v_phrases")(
        lambda spark, sf, rule=_rule: asked(spark, sf).select("doc_id", rule(F.col("question")).alias("question")))


@query("targeted_ambiguous", f"""{V}, w AS (SELECT doc_id, question, {WORDS} AS w FROM v_phrases),
f AS (SELECT *, list_min(list_filter(range(3, len(w) - 1), lambda i: regexp_matches(w[i], '^\\p{{Lu}}') AND length(w[i]) > 3)) AS i FROM w)
SELECT doc_id, CASE WHEN len(w) > 4 AND i IS NOT NULL THEN array_to_string(list_concat(list_append(w[1:i - 1], {pick(ad.PRONOUNS, 'w[i]')}), w[i + 1:]), ' ')
  {without(ad.TARGETED_CONTEXT)} {MODIFIED} END AS question FROM f""")
def targeted_ambiguous(spark, sf):
    return asked(spark, sf).select("doc_id", ad.targeted_ambiguous(F.col("question")).alias("question"))


@query("vulnerable_categories")
def vulnerable_categories(spark, sf):
    groups = bi.scores_by_field(responses(spark, sf), ["query_type", "complexity"], median=False)
    return ad.vulnerable(bi.disparities(groups, bi.anova(groups).withColumn("significant", F.lit(True))))


@query("targeted_variants", f"""{V},
g AS (SELECT query_type, complexity, avg(length(question)) AS s FROM v_phrases GROUP BY ALL),
t AS (SELECT min_by(query_type, s) AS v FROM (SELECT query_type, avg(length(question)) AS s FROM v_phrases GROUP BY query_type) a),
l AS (SELECT min_by(complexity, s) AS v FROM (SELECT complexity, avg(length(question)) AS s FROM v_phrases GROUP BY complexity) b),
pt AS (SELECT * FROM v_phrases WHERE query_type = (SELECT v FROM t) ORDER BY doc_id LIMIT 5), pl AS (SELECT * FROM v_phrases WHERE complexity = (SELECT v FROM l) ORDER BY doc_id LIMIT 5),
o AS (SELECT question_id, question AS original_text, {RULES['targeted_paraphrase'][1]} AS question, 'paraphrase' AS technique, 'para' AS suffix FROM pt
 UNION ALL SELECT question_id, question, {RULES['targeted_irrelevant'][1]}, 'irrelevant_context', 'irrel' FROM pt
 UNION ALL SELECT question_id, question, CASE WHEN len({WORDS}) > 4 AND list_min(list_filter(range(3, len({WORDS}) - 1), lambda i: regexp_matches(({WORDS})[i], '^\\p{{Lu}}') AND length(({WORDS})[i]) > 3)) IS NOT NULL THEN
   (SELECT array_to_string(list_concat(list_append(w[1:i - 1], {pick(ad.PRONOUNS, 'w[i]')}), w[i + 1:]), ' ') FROM (SELECT {WORDS} AS w, list_min(list_filter(range(3, len({WORDS}) - 1), lambda i: regexp_matches(({WORDS})[i], '^\\p{{Lu}}') AND length(({WORDS})[i]) > 3)) AS i) q)
   {without(ad.TARGETED_CONTEXT)} {MODIFIED} END, 'ambiguity', 'ambig' FROM pl
 UNION ALL SELECT question_id, question, {RULES['impossible_questions'][1]}, 'impossible', 'imp' FROM (SELECT * FROM v_phrases ORDER BY doc_id LIMIT 5) z)
SELECT concat(question_id, '_', suffix) AS question_id, question, technique, original_text FROM o WHERE question IS NOT NULL AND question <> original_text""")
def targeted_variants(spark, sf):
    """Vulnerable here: the type and the level with the shortest questions."""
    rows = asked(spark, sf).withColumn("special_categories", F.filter(F.split("special", r"\|"), lambda x: x != "")).drop("special")
    shortest = lambda f: rows.groupBy(f).agg(F.avg(F.length("question")).alias("s")).agg(
        F.min_by(f, "s").alias("value")).select(F.lit(f).alias("field"), "value")
    weak = shortest("query_type").unionByName(shortest("complexity"))
    return ad.targeted(rows, weak, "doc_id").select(
        "question_id", "question", "adversarial.technique", "adversarial.original_text")
