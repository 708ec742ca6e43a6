"""Evaluation-shaped views over the given tables.

Each view is one SQL text that Spark and DuckDB read alike; ``{name}`` stands for
a table. ``view`` runs it in Spark, ``cte`` gives it as a WITH item for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {}

# A response log: three systems, failures, scores, types, complexities, tags.
VIEWS["v_responses"] = """
SELECT event_id AS question_ix, concat('sys', CAST(user_id % 3 AS STRING)) AS system,
       event_type <> 'error' AS success, value / 100 AS latency,
       CAST(k AS DOUBLE) / 100 AS score, ts,
       CASE k % 7 WHEN 0 THEN 'factoid' WHEN 1 THEN 'definitional' WHEN 2 THEN 'procedural'
                  WHEN 3 THEN 'comparative' WHEN 4 THEN 'causal' WHEN 5 THEN 'quantitative'
                  ELSE 'open_ended' END AS query_type,
       concat('L', CAST(1 + event_id % 3 AS STRING)) AS complexity,
       concat('p', CAST(user_id % 20 AS STRING)) AS paper_id,
       CASE WHEN k % 10 = 0 THEN 'temporal|impossible' WHEN k % 10 = 1 THEN 'impossible'
            WHEN k % 10 = 2 THEN 'ambiguous' ELSE '' END AS tags
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

# Answer against gold: a user turn as gold, the assistant turn after it as answer.
VIEWS["v_qa"] = """
SELECT conv_id, turn, gold, answer
FROM (SELECT conv_id, turn, role, text AS gold,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
      FROM {conversations}) c
WHERE role = 'user' AND next_role = 'assistant'
"""

# Answers close to their gold text: a document and the same text less its first words.
VIEWS["v_close"] = """
SELECT doc_id, text AS gold,
       CASE WHEN doc_id % 2 = 0 THEN text
            ELSE substring(text, 1 + CAST(floor(length(text) / 2) AS INT)) END AS answer
FROM {documents}
"""

VIEWS["v_strata"] = """
SELECT CAST(doc_id AS STRING) AS doc_id, coalesce(lang, 'unknown') AS stratum,
       md5(concat(CAST(doc_id AS STRING), ':42')) AS pick
FROM {documents}
"""

# Questions with every validation outcome.
VIEWS["v_questions"] = """
SELECT doc_id, concat('q_', substring(md5(question), 1, 12)) AS question_id, question, answer,
       query_type, complexity, concat('p', CAST(doc_id % 20 AS STRING)) AS paper_id
FROM (SELECT doc_id,
        concat(CASE doc_id % 6 WHEN 0 THEN 'What is ' WHEN 1 THEN 'How does ' WHEN 2 THEN 'Why is '
                               WHEN 3 THEN 'When was ' WHEN 4 THEN 'Which [slot] of ' ELSE '' END,
               split_part(text, ' ', 2), CASE WHEN doc_id % 7 = 0 THEN '' ELSE '?' END) AS question,
        substring(text, 1, CAST(doc_id % 60 AS INT)) AS answer,
        CASE WHEN doc_id % 11 = 0 THEN NULL
             ELSE CASE doc_id % 3 WHEN 0 THEN 'factoid' WHEN 1 THEN 'causal' ELSE 'procedural' END
        END AS query_type,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('L', CAST(1 + doc_id % 3 AS STRING)) END
          AS complexity
      FROM {documents}) q
"""

# Longer question texts for the rewriting rules: prefix, three words, clause.
VIEWS["v_phrases"] = """
SELECT doc_id, concat('q_', substring(md5(question), 1, 12)) AS question_id, question,
       query_type, complexity, paper_id, special
FROM (SELECT doc_id, paper_id, query_type, complexity,
        CASE WHEN doc_id % 5 = 0 THEN 'ambiguous|impossible' WHEN doc_id % 5 = 1 THEN 'temporal'
             ELSE '' END AS special,
        concat(CASE doc_id % 9 WHEN 0 THEN 'What is ' WHEN 1 THEN 'How does ' WHEN 2 THEN 'Why is '
                               WHEN 3 THEN 'When was ' WHEN 4 THEN 'Where might ' WHEN 5 THEN 'Can you say '
                               WHEN 6 THEN 'What does ' WHEN 7 THEN 'Is an advantage or difference of '
                               ELSE 'Name ' END,
               concat_ws(' ', split_part(text, ' ', 2), split_part(text, ' ', 3), split_part(text, ' ', 4)),
               CASE doc_id % 8 WHEN 0 THEN ' in the Second Part' WHEN 1 THEN ' of 2021'
                               WHEN 2 THEN ' for this paper' WHEN 3 THEN ' in the context of work'
                               WHEN 4 THEN ' from Smith 2020' WHEN 5 THEN ' according to them'
                               WHEN 6 THEN ' do' ELSE ' will Matter to people' END,
               CASE WHEN doc_id % 17 = 0 THEN '' ELSE '?' END) AS question
      FROM (SELECT doc_id, text, concat('p', CAST(doc_id % 20 AS STRING)) AS paper_id,
                   CASE doc_id % 3 WHEN 0 THEN 'factoid' WHEN 1 THEN 'causal' ELSE 'procedural' END AS query_type,
                   concat('L', CAST(1 + doc_id % 3 AS STRING)) AS complexity FROM {documents}) d) q
"""

# Paper-shaped text: headings, captions, marks and a bibliography around each document.
VIEWS["v_papers"] = """
SELECT doc_id, concat('A study of ', split_part(text, ' ', 2), ' in statistics', chr(10),
  'Ann Author, Bob Writer and Cy Third', chr(10),
  'Abstract', chr(10), substring(text, 1, 80), chr(10), chr(10),
  'Keywords: ', split_part(text, ' ', 2), '; ', split_part(text, ' ', 3), ', data', chr(10), chr(10),
  '1. Introduction', chr(10), 'We propose ', split_part(text, ' ', 2), ' [1, 2]. ', text, chr(10),
  '2.1. Method', chr(10), 'See Figure 1 and [', CAST(1 + doc_id % 4 AS STRING), ']. This is like (Smith et al., 2020; Jones, 2021).', chr(10),
  'Figure 1: Overview of ', split_part(text, ' ', 3), '.', chr(10),
  'Table 2. Scores of ', split_part(text, ' ', 3), '. As fig. 1 and Table 2 show, recall is 9', CAST(doc_id % 10 AS STRING), '%.', chr(10),
  '3 Results', chr(10), 'Results show that the new method improves recall by ', CAST(doc_id % 50 AS STRING), '% improvement over it. ',
  'We find that ', split_part(text, ' ', 2), ' outperforms ', split_part(text, ' ', 3), '.', chr(10),
  'References', chr(10),
  '[1] A. Author. (2020). First title. Journal, 1(2), 3-4.', chr(10),
  '[2] B. Author and C. Other. (2021). Second title. Proceedings, 5(6), 7-8. doi: 10.1/x', CAST(doc_id AS STRING), '.', chr(10),
  '[3] D. Person, Third title, 2019, https://example.org/', CAST(doc_id AS STRING), '.') AS full_text
FROM {documents}
"""

# Retrieval responses: text pieces of a document against its first pieces as gold.
# Every third piece carries no id and must match by text.
VIEWS["v_pieces"] = """
SELECT doc_id, CAST(ix AS INT) AS ix, substring(text, CAST(1 + 200 * ix AS INT), 200) AS piece,
       CASE WHEN ix % 3 = 0 THEN '' WHEN ix % 3 = 1 THEN concat('c', CAST(ix AS STRING))
            ELSE concat('x', CAST(ix AS STRING)) END AS context_id,
       md5(concat(CAST(doc_id AS STRING), ':', CAST(ix AS STRING))) AS pick
FROM (SELECT doc_id, text, {range_of_pieces} AS ix FROM {documents}) d
"""


def spark_range() -> str:
    return "explode(sequence(0, CAST(floor((length(text) - 1) / 200) AS INT)))"


def duck_range() -> str:
    return "unnest(range(0, 1 + CAST(floor((length(text) - 1) / 200) AS INT)))"


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


HEAVY = {"documents", "pages", "conversations"}  # long texts, much work per row


WAVES = 3  # row groups per core from which a scan is even enough as it is


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that feeds fewer tasks than there are cores, dealt out evenly.

    A row group is never cut, so a file of one group is one task however many splits it
    has: the splits that get rows are counted, in the footers only. A scan with enough of
    them, as on any large table, is left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if busy >= WAVES * cores else df.repartition(WAVES * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("{range_of_pieces}", spark_range())
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def cte(*names: str) -> str:
    """``WITH`` items for the oracle, to be followed by more items or a SELECT."""
    items = []
    for name in names:
        text = VIEWS[name].replace("{range_of_pieces}", duck_range())
        items.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return "WITH " + ", ".join(items)
