"""Documents to cleaned text and chunks that know their split. One lazy plan; only the ids
that are ranked for the splits are shuffled, never a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.operators import corpus as co
from qamill.sources import sinks


@dataclass(frozen=True)
class CorpusOptions:
    drop_special: bool = False
    chunk_by: str = "chars"
    chunk_size: int = 1000
    chunk_overlap: int = 100
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    stratum: str | None = None
    seed: int = 42


def build(documents: DataFrame, options: CorpusOptions = CorpusOptions()) -> tuple[DataFrame, DataFrame]:
    """Chunks and splits of ``(doc_id, text, …)``."""
    assign = lambda df: co.assign_splits(df, "doc_id", options.stratum, options.ratios, options.seed)
    cleaned = assign(documents).withColumn("text", tx.clean(F.col("text"), options.drop_special))
    chunks = co.chunk(cleaned, options.chunk_by, options.chunk_size, options.chunk_overlap, ["split"])
    return chunks, assign(documents.select("doc_id", *([options.stratum] if options.stratum else [])))


def write(documents: DataFrame, path: str, options: CorpusOptions = CorpusOptions(), mode: str = "error") -> None:
    chunks, splits = build(documents, options)
    sinks.write_splits(chunks, splits, path, mode)
