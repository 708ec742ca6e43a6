"""Registered queries: retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.functions.rows import unnest
from qamill.operators import retrieval as rt
from qamill.operators import vector_index as vi
from qamill.plans.fixtures import cte, table, view
from qamill.session import materialise

QUERIES, ORACLES = {}, {}


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return corpus, corpus


def _near(spark, sf_dir, k):
    queries, corpus = _vectors(spark, sf_dir)
    return rt.dense_top_k(queries, corpus, k, skip_self=True)


def dense_top_k(spark, sf_dir):
    return _near(spark, sf_dir, 5).select(
        "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"),
        F.round("distance", 6).alias("distance"),
    )


NEAR_SQL = """
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS query_label, d.label AS doc_label,
         list_sum(list_transform(range(1, 65), lambda i:
           (CAST(q.embedding[i] AS DOUBLE) - CAST(d.embedding[i] AS DOUBLE)) ** 2)) AS distance
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM pairs)
"""

QUERIES["dense_top_k"] = dense_top_k
ORACLES["dense_top_k"] = f"""
WITH {NEAR_SQL}
SELECT query_id, doc_id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 5
"""


def indexed_top_k(spark, sf_dir):
    """The same through the metric index."""
    queries, corpus = _vectors(spark, sf_dir)
    return vi.Index(corpus, materialise).top_k(queries, 5, skip_self=True).select(
        "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


QUERIES["indexed_top_k"] = indexed_top_k
ORACLES["indexed_top_k"] = ORACLES["dense_top_k"]


def retrieval_metrics_at_k(spark, sf_dir):
    """Top 10 by L2, relevant = same label, then every metric at k."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    flagged = rt.flags_by_label(_near(spark, sf_dir, 10), labels)
    out = rt.average_scores(flagged.withColumn("system", F.lit("l2")), ["system"])
    return out.select("system", "metric", F.round("value", 6).alias("value"))


def _metric_sql(k: int) -> str:
    return f"""
  SELECT 'precision@{k}' AS metric, avg(h{k} / least({k}, n)) AS value FROM per
  UNION ALL SELECT 'recall@{k}', avg(h{k} / n_gold) FROM per
  UNION ALL SELECT 'ndcg@{k}', avg(d{k} / list_sum(list_transform(
      range(1, 1 + CAST(least({k}, n_gold) AS BIGINT)), lambda i: 1 / log2(i + 1)))) FROM per"""


PER_SQL = ", ".join(
    f"sum(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END) AS h{k}, "
    f"sum(CASE WHEN hit AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS d{k}"
    for k in rt.K_VALUES
)
ALL_METRICS_SQL = (
    " UNION ALL ".join(_metric_sql(k) for k in rt.K_VALUES)
    + " UNION ALL SELECT 'mrr', avg(coalesce(1 / first_hit, 0)) FROM per"
)

QUERIES["retrieval_metrics_at_k"] = retrieval_metrics_at_k
ORACLES["retrieval_metrics_at_k"] = f"""
WITH {NEAR_SQL},
sizes AS (SELECT label, count(*) - 1 AS n_gold FROM embeddings GROUP BY label),
hits AS (SELECT query_id, rank, query_label = doc_label AS hit, n_gold
         FROM ranked JOIN sizes ON label = query_label WHERE rank <= 10),
per AS (SELECT query_id, n_gold, count(*) AS n, min(CASE WHEN hit THEN rank END) AS first_hit, {PER_SQL}
        FROM hits GROUP BY query_id, n_gold)
SELECT 'l2' AS system, metric, round(value, 6) AS value FROM ({ALL_METRICS_SQL}) m
"""


def _responses(spark, sf_dir):
    """Nested responses: pieces of a document in hashed order, its first two as gold."""
    pieces = view(spark, sf_dir, "v_pieces")
    item = F.struct("pick", "ix", F.col("context_id").alias("id"), F.col("piece").alias("text"))
    gold = F.when(F.col("ix") < 2, F.struct(
        "ix", F.concat(F.lit("c"), F.col("ix").cast("string")).alias("id"), F.col("piece").alias("text")))
    return (
        pieces.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(item)).alias("contexts"),
             F.sort_array(F.collect_list(gold)).alias("gold"))
        .withColumn("system", F.concat(F.lit("sys"), (F.col("doc_id") % 3).cast("string")))
    )


def context_relevance(spark, sf_dir):
    flags = rt.relevance(F.col("contexts"), F.col("gold"))
    ranked = F.arrays_zip(F.transform("contexts", lambda c: c["ix"]).alias("ix"), flags.alias("relevant"))
    return (
        unnest(_responses(spark, sf_dir), ranked, ["doc_id"], "pos")
        .select("doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"),
                F.col("item.ix").cast("bigint").alias("ix"), F.col("item.relevant").alias("relevant"))
    )


DUCK_TOKENS = (
    r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), "
    r"'[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x85\p{{Z}}]', '', 'g'), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+'), lambda x: x <> ''))"
)

REL_SQL = f"""{cte('v_pieces')},
toks AS (SELECT *, {DUCK_TOKENS.format('piece')} AS tok,
                row_number() OVER (PARTITION BY doc_id ORDER BY pick, ix) AS rank FROM v_pieces),
golds AS (SELECT doc_id, ix, concat('c', CAST(ix AS STRING)) AS gid, tok AS gtok FROM toks WHERE ix < 2),
rel AS (
  SELECT t.doc_id, t.rank, t.ix, max(CASE WHEN t.context_id <> '' THEN t.context_id = gid
    WHEN len(t.tok) = 0 OR len(gtok) = 0 THEN false
    ELSE len(list_intersect(t.tok, gtok)) / len(list_distinct(list_concat(t.tok, gtok))) > 0.8 END) AS relevant
  FROM toks t JOIN golds g ON t.doc_id = g.doc_id GROUP BY t.doc_id, t.rank, t.ix)
"""

QUERIES["context_relevance"] = context_relevance
ORACLES["context_relevance"] = f"""{REL_SQL}
SELECT doc_id, rank, CAST(ix AS BIGINT) AS ix, relevant FROM rel
"""


def retrieval_by_system(spark, sf_dir):
    out = rt.retrieval_metrics(_responses(spark, sf_dir), ["system"])
    return out.select("system", "metric", F.round("value", 6).alias("value"))


def _system_sql() -> str:
    parts = []
    for k in rt.K_VALUES:
        parts.append(f"SELECT system, 'precision@{k}' AS metric, avg(h{k} / least({k}, n)) AS value FROM per GROUP BY system")
        parts.append(f"SELECT system, 'recall@{k}', avg(h{k} / n_gold) FROM per GROUP BY system")
        parts.append(f"SELECT system, 'ndcg@{k}', avg(d{k} / list_sum(list_transform(range(1, 1 + CAST(least({k}, n_gold) AS BIGINT)), lambda i: 1 / log2(i + 1)))) FROM per GROUP BY system")
    parts.append("SELECT system, 'mrr', avg(coalesce(1 / first_hit, 0)) FROM per GROUP BY system")
    return " UNION ALL ".join(parts)


QUERIES["retrieval_by_system"] = retrieval_by_system
ORACLES["retrieval_by_system"] = f"""{REL_SQL},
gold_n AS (SELECT doc_id, count(*) AS n_gold FROM golds GROUP BY doc_id),
hits AS (SELECT r.doc_id, rank, relevant AS hit, n_gold FROM rel r JOIN gold_n g ON r.doc_id = g.doc_id),
per AS (SELECT concat('sys', CAST(doc_id % 3 AS STRING)) AS system, doc_id, n_gold, count(*) AS n,
               min(CASE WHEN hit THEN rank END) AS first_hit, {PER_SQL}
        FROM hits GROUP BY doc_id, n_gold)
SELECT system, metric, round(value, 6) AS value FROM ({_system_sql()}) m
"""


def mrr(spark, sf_dir):
    return retrieval_by_system(spark, sf_dir).where("metric = 'mrr'").select("system", F.col("value").alias("mrr"))


QUERIES["mrr"] = mrr
ORACLES["mrr"] = f"""{REL_SQL}
SELECT concat('sys', CAST(doc_id % 3 AS STRING)) AS system, round(avg(coalesce(1 / first_hit, 0)), 6) AS mrr
FROM (SELECT doc_id, min(CASE WHEN relevant THEN rank END) AS first_hit FROM rel GROUP BY doc_id) p
GROUP BY doc_id % 3
"""


def context_precision_recall(spark, sf_dir):
    rows = _responses(spark, sf_dir).select(
        "doc_id", rt.relevance(F.col("contexts"), F.col("gold")).alias("flags"), F.size("gold").alias("n"))
    precision, recall = rt.context_precision_recall(F.col("flags"), F.col("n"))
    return rows.select("doc_id", F.round(precision, 6).alias("context_precision"),
                       F.round(recall, 6).alias("context_recall"))


QUERIES["context_precision_recall"] = context_precision_recall
ORACLES["context_precision_recall"] = f"""{REL_SQL}
SELECT r.doc_id, round(avg(CAST(relevant AS INT)), 6) AS context_precision,
       round(sum(CAST(relevant AS INT)) / max(n), 6) AS context_recall
FROM rel r JOIN (SELECT doc_id, count(*) AS n FROM golds GROUP BY doc_id) g ON r.doc_id = g.doc_id
GROUP BY r.doc_id
"""


def _jaccard(tokens):
    def run(spark, sf_dir):
        pairs = view(spark, sf_dir, "v_qa").select("conv_id", "turn", "gold", "answer").unionByName(
            view(spark, sf_dir, "v_close").select(
                (-F.col("doc_id") - 1).alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), "gold", "answer"))
        score = tx.jaccard(F.array_distinct(tokens(F.col("gold"))), F.array_distinct(tokens(F.col("answer"))))
        return pairs.select("conv_id", "turn", F.round(score, 6).alias("similarity"))
    return run


def _jaccard_sql(tokens: str) -> str:
    return f"""{cte('v_qa', 'v_close')},
pairs AS (SELECT conv_id, turn, gold, answer FROM v_qa
          UNION ALL SELECT -doc_id - 1, 0, gold, answer FROM v_close),
t AS (SELECT conv_id, turn, {tokens.format('gold')} AS a, {tokens.format('answer')} AS b FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM t
"""


QUERIES["jaccard_pairs"] = _jaccard(tx.tokens_strip)
ORACLES["jaccard_pairs"] = _jaccard_sql(DUCK_TOKENS)
QUERIES["jaccard_word_tokens"] = _jaccard(tx.tokens_word)
ORACLES["jaccard_word_tokens"] = _jaccard_sql(
    r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))")
