"""The quality model keeps every word and every n-gram, and the joined scores are those of the definition."""

import numpy as np
import pytest
from llm_cases import prose, rows_of
from pyspark.sql import functions as F

from qamill.llm import kneser


def trusted(spark):
    # every text has two words of its own, of the same shape as all others
    texts = [prose(i, 40) + " rare" + "abcdefghij"[i % 10] * (2 + i // 10) + " only" + "klmnopqrst"[i % 10] * (2 + i // 10)
             for i in range(60)]
    return texts, spark.createDataFrame([("en", t) for t in texts], "lang string, text string")


def test_rare_words_and_rare_ngrams_are_told_apart(spark):
    texts, rows = trusted(spark)
    model = kneser.train(rows)
    own = texts[0].split()[-2:]
    assert set(own) <= set(model.vocabulary["en"])
    right, n = model.cost("en", " ".join(own))
    swapped, _ = model.cost("en", " ".join(own[::-1]))
    other, _ = model.cost("en", f"{own[0]} {texts[1].split()[-1]}")
    assert n == 2 and right < other - 1 and right < swapped - 1


def test_every_ngram_is_in_the_table(spark):
    texts, rows = trusted(spark)
    grams = kneser.Grams(["en"] * len(texts), texts, kneser.Codes())
    kept = {r["key"] for r in rows_of(kneser.train(rows).table)}
    assert set(grams.wanted().tolist()) <= kept


def test_scores_by_join_equal_the_costs_of_the_model(spark, monkeypatch):
    texts, rows = trusted(spark)
    model = kneser.train(rows)
    docs = [(i, t + " unheard", "en" if i % 7 else "xx") for i, t in enumerate(texts)] + [(90, "", "en"), (91, None, "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    monkeypatch.setattr(kneser, "CHUNK", 2000)
    got = rows_of(kneser.score(frame.select(F.struct("*").alias("doc"), "lang"), model))
    assert len(got) == len(docs)
    for row in got:
        want = model.cost(row["lang"], row["doc"]["text"])
        assert (row["cost"] is None) if want is None else row["cost"] == pytest.approx(want[0]) and row["n"] == want[1]


def test_hashes_are_those_of_spark(spark):
    values = np.array([0, 1, -5, 2**62, -2**63], dtype=np.int64)
    want = [r["h"] for r in rows_of(spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "v long, i long")
                                    .select("i", F.xxhash64("v", F.lit(7).cast("long")).alias("h")).orderBy("i"))]
    assert kneser._hashed(np.full(5, 7), kneser._hashed(values, 42)).tolist() == want
