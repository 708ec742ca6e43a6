"""Cleaning, chunking and splitting of a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.functions.rows import unnest
from qamill.functions.picks import SCALE  # noqa: F401  (documented range of picks)
from qamill.operators.ranking import hashed_rank

SMALL_SIDE = 100_000  # strata up to which their two edges are broadcast

# Extension groups of the format dispatch.
FORMATS = {
    "text": ["txt", "md", "rst"],
    "pdf": ["pdf"],
    "html": ["html", "htm"],
    "word": ["doc", "docx"],
    "structured": ["csv", "xls", "xlsx"],
    "data": ["json", "xml", "yaml"],
}

# Character references that occur in plain pages.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
]
HIDDEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>"
)
HEAD = r"(?is)<head\b.*?</head\s*>"
BLOCK = (
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|header|footer"
    r"|nav|main|aside|blockquote|pre|form|figure)\b[^>]*>"
)
TAG = r"</?[a-zA-Z!][^>]*>"


def route(path: Column) -> Column:
    """Extension group of a path; null when the format is not supported."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for name, extensions in FORMATS.items():
        hit = ext.isin(extensions)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def document_id(path: Column, modified: Column) -> Column:
    """S3: first 12 hex digits of md5(``path:modified``)."""
    return F.substring(F.md5(F.concat_ws(":", path, modified.cast("string"))), 1, 12)


def html_text(html: Column) -> Column:
    """T4: visible text of a page, one line per block."""
    out = F.regexp_replace(html, HIDDEN, "")
    out = F.regexp_replace(out, HEAD, "")
    out = F.regexp_replace(out, BLOCK, "\n")
    out = F.regexp_replace(out, TAG, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\x0B\f]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+\z", "")


def char_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Windows of ``size`` characters, ``size - overlap`` apart, to the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    n = F.length(text)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)),
        lambda i: F.substring(text, i + 1, F.lit(size)),
    )
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def sentence_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Pack sentences up to ``size``; start the next chunk with the trailing
    sentences whose lengths add up to at most ``overlap``. A fold inside the row."""
    none = F.array().cast("array<string>")

    def carried(cur: Column) -> Column:
        last = F.aggregate(
            F.reverse(cur),
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("total"), F.lit(True).alias("open")),
            lambda a, s: F.when(
                a["open"] & (a["total"] + F.length(s) <= overlap),
                F.struct((a["k"] + 1).alias("k"), (a["total"] + F.length(s)).alias("total"),
                         F.lit(True).alias("open")),
            ).otherwise(F.struct(a["k"].alias("k"), a["total"].alias("total"),
                                 F.lit(False).alias("open"))),
            lambda a: a["k"],
        )
        return F.slice(cur, F.size(cur) - last + 1, last)

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda a, s: a + F.length(s))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["size"] + F.length(s) > size) & (F.size(acc["cur"]) > 0)
        kept = carried(acc["cur"])
        return F.when(
            full,
            F.struct(
                F.concat(acc["out"], F.array(F.array_join(acc["cur"], " "))).alias("out"),
                F.concat(kept, F.array(s)).alias("cur"),
                (total(kept) + F.length(s)).alias("size"),
            ),
        ).otherwise(
            F.struct(
                acc["out"].alias("out"),
                F.concat(acc["cur"], F.array(s)).alias("cur"),
                (acc["size"] + F.length(s)).alias("size"),
            )
        )

    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("size"))
    return F.aggregate(
        tx.sentences(text), start, step,
        lambda acc: F.when(
            F.size(acc["cur"]) > 0,
            F.concat(acc["out"], F.array(F.array_join(acc["cur"], " "))),
        ).otherwise(acc["out"]),
    )


def chunk(documents: DataFrame, by: str = "chars", size: int = 1000, overlap: int = 100,
          keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``doc_id, chunk_ix, chunk_name, text`` and the columns ``keep``. No shuffle.

    Any ``by`` other than ``chars`` means sentences.
    """
    keep = keep or []
    cut = char_chunks if by == "chars" else sentence_chunks
    name = F.format_string("%s_chunk_%03d", F.col("doc_id").cast("string"), F.col("chunk_ix"))
    return (
        unnest(documents, cut(F.col("text"), size, overlap), ["doc_id", *keep], "chunk_ix", "text")
        .select("doc_id", "chunk_ix", name.alias("chunk_name"), "text", *keep)
    )


def chunk_document_id(name: Column) -> Column:
    """The document a chunk name belongs to."""
    return F.regexp_replace(name, r"_chunk_\d+$", "")


def normalise_ratios(train: float, val: float, test: float) -> tuple[float, float, float]:
    """Scale to 1 unless they already add up to 1 within 1e-10."""
    total = train + val + test
    if abs(total - 1.0) <= 1e-10:
        return train, val, test
    return train / total, val / total, test / total


def assign_splits(
    documents: DataFrame, id_column: str = "doc_id", stratum: str | None = None,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42,
) -> DataFrame:
    """Train, val and test of exact sizes, per stratum when one is given.

    Ids are ordered by their md5 with the seed. The first floor(n·train) are train;
    of the m left, the first floor(m·val/(val+test)) are val. A null stratum counts
    as ``unknown``. Every stratum is ranked in hash buckets, so one that holds most
    rows is spread like the others. Only ids are ranked: what comes back are the two last
    ids of train and val per stratum, and every row is compared with them where it lies.
    These few rows are broadcast while there are at most ``SMALL_SIDE`` strata.
    """
    train, val, test = normalise_ratios(*ratios)
    of_rest = val / (val + test) if val + test > 0 else 0.0
    columns = documents.columns
    level = F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")) if stratum else F.lit("all")
    marked = documents.withColumn("_stratum", level).withColumn(
        "_pick", F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}"))))
    ranked = hashed_rank(marked.select("_stratum", "_pick", F.col(id_column).alias("_id")), ["_stratum"], "_pick", "_id")
    n_train = F.floor(F.col("group_size") * F.lit(train))
    n_val = F.floor((F.col("group_size") - n_train) * F.lit(of_rest))
    place = F.struct("_pick", "_id")
    edges = ranked.groupBy(F.col("_stratum").alias("_level")).agg(
        F.max(F.when(F.col("rank_ix") <= n_train, place)).alias("_train"),
        F.max(F.when(F.col("rank_ix") <= n_train + n_val, place)).alias("_val"))
    if stratum is None or edges.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE:
        edges = F.broadcast(edges)
    own = F.struct(F.col("_pick"), F.col(id_column).alias("_id"))
    within = lambda edge: F.coalesce(own <= F.col(edge), F.lit(False))
    split = F.when(within("_train"), "train").when(within("_val"), "val").otherwise("test")
    return marked.join(edges, F.col("_stratum") == F.col("_level")).select(*columns, split.alias("split"))


def split_sizes(splits: DataFrame, *by: str) -> DataFrame:
    """Rows per split."""
    return splits.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))
