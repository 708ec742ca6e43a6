"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. The chance that a sentence is toxic is a logistic function of its
different words and their stems (first letters), and a document is toxic unless every sentence is
clean: 1 - product(1 - chance). Only documents carry labels; the likelihood of these labels is
maximised by full-batch proximal gradient steps, whose L1 term leaves no weight on words that say
nothing. Executors turn the sampled documents into bags, the driver fits the weights, executors score
every sentence of every text, which also tells where the offending ones are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm.common import few, first_per_key, text_batches

SAMPLE = 3000        # labelled documents of each label that the weights are fitted on
LONGEST = 20_000     # words of the longest document in the sample (scoring has no such limit)
BUCKETS = 1 << 20
STEMS = (4, 5, 6, 7)
RARE = 3             # documents of the sample a feature must occur in to get a weight
STEPS = 300
RATE = 0.3
SPARSE = 1e-4        # L1 term, in mean log likelihood
START = -7.0         # log odds of a sentence without any known word, before fitting
LEVEL = 0.7          # of a document
OFFENDING = 0.5      # of a sentence
MEMO = 1 << 20       # different words whose weight a task remembers

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word: itself, and its beginnings of 4 to 7 letters where it is longer."""
    names = [f"={word}", *[word[:k] for k in STEMS if len(word) > k]]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def bag(text: str) -> list[np.ndarray]:
    """The different buckets of every sentence that has a word."""
    found = []
    for s in SENTENCE.finditer(text):
        words = set(WORD.findall(s[0].lower()))
        if words:
            found.append(np.unique([b for w in words for b in features(w)]))
    return found


class Model:
    """A weight per bucket and the log odds of a sentence without weights."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]], share: dict[int, float]):
        """``rows``: label, buckets of all sentences one after the other, sentence lengths.

        ``share`` holds the number of documents each sampled one of a label stands for.
        """
        self.weights: dict[int, float] = {}
        self.start = START
        rows = [r for r in rows if len(r[2])]
        if not rows:
            return
        label = np.array([r[0] for r in rows], dtype=float)
        counts = np.array([len(r[2]) for r in rows])
        doc = np.repeat(np.arange(len(rows)), counts)
        length = np.concatenate([r[2] for r in rows])
        # a feature counts if enough documents have it
        seen = np.zeros(BUCKETS, dtype=np.int32)
        for r in rows:
            seen[np.unique(r[1])] += 1
        known = np.flatnonzero(seen >= RARE)
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        at = np.concatenate([place[r[1]] for r in rows])
        sentence = np.repeat(np.arange(len(length), dtype=np.int32), length)[at >= 0]
        at = at[at >= 0]
        weight = np.array([share[int(x)] for x in label])
        weight /= weight.sum()
        w, b = np.zeros(len(known)), START
        seen_w, seen_b = np.full(len(known), 1e-8), 1e-8
        for step in range(STEPS):
            z = b + np.bincount(sentence, w[at], minlength=len(length))
            clean = -np.logaddexp(0, z)                       # log of the chance of a clean sentence
            none = np.minimum(np.bincount(doc, clean, minlength=len(rows)), -1e-12)
            toxic = -np.expm1(none)
            # d(log likelihood)/d(none): -1 per clean document, exp(none) / (1 - exp(none)) per toxic one
            pull = weight * np.where(label > 0, np.exp(none) / np.maximum(toxic, 1e-12), -1.0)
            gradient = pull[doc] / (1 + np.exp(-z))           # by z of a sentence
            by_w = np.bincount(at, gradient[sentence], minlength=len(known))
            by_b = gradient.sum()
            seen_w, seen_b = seen_w + by_w**2, seen_b + by_b**2
            rate_w = RATE / np.sqrt(seen_w)
            w = w + rate_w * by_w
            w = np.sign(w) * np.maximum(np.abs(w) - rate_w * SPARSE, 0)
            b += RATE / np.sqrt(seen_b) * by_b
        used = w != 0
        self.weights = dict(zip(known[used].tolist(), w[used].tolist()))
        self.start = float(b)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted on ``sample`` documents of each label, those with the smallest hashed ids, whole.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; an id with both counts as 1).
    Held-out ids, null ids, null labels and documents of more than LONGEST words are left out;
    repeated rows count once. At most 2 * ``sample`` * LONGEST words reach the driver.
    """
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marks = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(usable & F.col("text").isNotNull()).select("doc_id", "text")
    short = F.regexp_count("text", F.lit(r"\S+")) <= LONGEST
    # ids and hashes are chosen first, so that no other text is moved
    light = texts.where(short).select("doc_id", F.xxhash64("text").alias("h")).distinct().join(marks, "doc_id")
    totals = {r["toxic"]: r["n"] for r in few(light.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")), 2)}
    chosen = F.broadcast(first_per_key(light, "toxic", ["doc_id", "h"], sample))
    picked = texts.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = {"doc_id": [], "toxic": [], "buckets": [], "lengths": []}
            for doc_id, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = bag(text)
                rows["doc_id"].append(doc_id)
                rows["toxic"].append(toxic)
                rows["buckets"].append((np.concatenate(found) if found else np.zeros(0)).astype(np.int32).tobytes())
                rows["lengths"].append(np.array([len(x) for x in found], dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=out_schema)

    out_schema = pa.schema([("doc_id", pa.string()), ("toxic", pa.int32()), ("buckets", pa.binary()), ("lengths", pa.binary())])
    bags = picked.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text").mapInArrow(
        run, "doc_id string, toxic int, buckets binary, lengths binary").toArrow()
    rows = sorted(zip(*(bags[c].to_pylist() for c in ("doc_id", "toxic", "buckets", "lengths"))))
    del bags
    taken = {k: sum(r[1] == k for r in rows) for k in totals}
    share = {k: totals[k] / max(1, taken[k]) for k in totals}
    return Model([(t, np.frombuffer(b, np.int32), np.frombuffer(n, np.int32)) for _, t, b, n in rows], share)


SENTENCES = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()),
                       T.StructField("offending", SENTENCES)])


class Scorer:
    """Scores texts; remembers the weights of words it has met, MEMO of them."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def word(self, word: str) -> float:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            # one bucket that two features of a word share counts once, as in training
            known = self.memo[word] = frozenset(x for x in features(word) if x in self.model.weights)
        return known

    def __call__(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        weights, none, n, offending = self.model.weights, 0.0, 0, []
        memo, word = self.memo, self.word
        for s in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(s[0].lower()))
            if not words:
                continue
            n += 1
            hits = set()
            for w in words:
                found = memo.get(w)
                hits |= word(w) if found is None else found
            z = self.model.start + sum(weights[x] for x in sorted(hits))
            none -= np.logaddexp(0.0, z)
            if z >= 0:  # a chance of OFFENDING or more
                offending.append((s.start(), s.end(), float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(none)), n, offending


def score_column(text: Column, model: Model, spark) -> Column:
    """Struct (score, n_sentences, offending) of a text; a null text counts as empty and scores 0."""
    shared = spark.sparkContext.broadcast(model)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in series:
            rows = [scorer(t) for t in texts]
            yield pd.DataFrame({
                "score": [r[0] for r in rows], "n_sentences": [r[1] for r in rows],
                "offending": [[dict(zip(("start", "end", "score"), x)) for x in r[2]] for r in rows]})

    return F.pandas_udf(run, SCORED)(text)


def judge(docs: DataFrame, labels: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending of every row of ``docs``.

    ``offending`` lists (start, end, score) of the sentences that are toxic rather than not, in code
    points of the text, end exclusive. A score sees the text only: equal texts get equal scores; null
    texts and texts without a word score 0. Without labelled documents nothing has weight and scores
    are near 0. Null and repeated ids are kept as they are, other columns ignored.
    """
    model = train(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model, docs.sparkSession).alias("p"))
    return out.select(
        "doc_id", "held_out", "p.score", F.when(F.col("p.score") >= level, 1).otherwise(0).cast("int").alias("predicted"),
        "p.n_sentences", "p.offending")
