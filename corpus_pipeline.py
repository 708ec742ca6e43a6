"""From raw documents to token ids: filter, deduplicate, redact, mix, encode.

Every stage takes (spark, docs, sf_dir), works on all the documents that its predecessor kept, and
returns the columns of ``documents``; the last one returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.llm import bpe, jaccard, kneser, mixing, secrets
from qamill.llm.common import WORD, table
from qamill.session import materialise

VOCABULARY = "byte_bpe_50k.json"


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no more perplexing than trusted ones (labelled quality 1) of their language."""
    return kneser.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id, null ids last.

    Texts are told apart by their 64-bit hash, not by their ids, so a text that shares its id with
    another is not lost and rows without an id are grouped like all others. Rows that repeat id and
    text leave one of them, by the hash of the other columns. Texts without a word are linked with
    nothing and all stay. An empty table gives no rows.
    """
    name = "_text_hash"
    hashed = docs.withColumn(name, F.xxhash64("text"))
    spoken = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    groups = jaccard.join(hashed.where(spoken).select(F.col(name).alias("doc_id"), "text")).dropDuplicates(["doc_id"])
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", name)
    texts = hashed.where(spoken).groupBy(name).agg(F.min(first).alias("first"))
    kept = texts.join(groups.select(F.col("doc_id").alias(name), "component_id"), name).groupBy("component_id").agg(
        F.min("first").alias("first")).select(F.col(f"first.{name}").alias(name), F.col("first.doc_id").alias("_first_id"))
    same = (hashed[name] == kept[name]) & hashed["doc_id"].eqNullSafe(kept["_first_id"])
    rest = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = hashed.where(spoken).join(kept, same, "left_semi").groupBy(name).agg(F.min_by(F.struct(*docs.columns), rest).alias("r"))
    return one.select("r.*").unionByName(docs.where(~spoken))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the texts replaced by a mark."""
    return _recounted(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weight: documents come as often as it takes them, none more than 3 times."""
    return _recounted(mixing.mixture(docs).select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids of every document of the mix."""
    out = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), ["doc_id", "source", "lang"], decode=False)
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier, the automata and the encoder are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents; every stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
