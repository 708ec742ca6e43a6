"""Tables and helpers of the tests in this folder; fixtures are imported by name."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in is that it for as with was be by on".split() + [
    f"{a}{b}{c}" for a in ("ba", "ke", "mi", "so") for b in ("ran", "tel", "vis") for c in ("", "der", "ting", "ly")]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(words))


def messy_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and equal texts."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, "one", "fr", "b", 3),
        (None, prose(1, 40), "en", "a", 1), (5, prose(2, 60), None, "c", 1), (6, prose(3, 30_000), "en", None, 1),
        (7, prose(2, 60), "en", "c", 1), (8, "é ñ 漢字 \U0001F600 <|endoftext|> x", "de", "é", 1)]
    rows += [(9, prose(4, 50), "en", "a", 1)] * 5
    return rows + [(100 + i, prose(100 + i, 20 + i), "en", "abc"[i % 3], 1) for i in range(20)]


CLASHING = ["size", "k", "n", "shard", "keep", "label", "t", "spans", "ids", "part", "doc", "target", "c", "_s",
            "epoch", "score", "host", "rule", "copies", "a", "b", "take", "level"]


@pytest.fixture(scope="session")
def messy(spark):
    rows = spark.createDataFrame(messy_rows(), DOCS)
    return rows.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vectors(spark):
    """Build a table of vectors from (vec_id, list)."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    return lambda rows: spark.createDataFrame([(i, v, "x", "y") for i, v in rows], schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
