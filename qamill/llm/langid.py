"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords of one to four letters (with word borders) are hashed into buckets; a text is the mean of
their embeddings. Executors turn the sampled texts into bucket counts, the driver trains on these
by stochastic gradient descent. Since everything is linear before the softmax, embeddings and
output weights are multiplied once, and a prediction is a mean of rows of one small table.
Probabilities are calibrated by a temperature on rows kept out of training; predictions below the
level that almost all correct ones of them reach are marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm.common import first_per_key

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
DIMENSION = 16
SAMPLE = 1500      # labelled texts per language that the classifier is fitted on
EPOCHS = 6
RATE = 0.2
SPREAD = 20.0
REJECT = 0.01      # share of correct held-back predictions that rejection may cost
PIECE = 1 << 20    # letters hashed at a time, so that long texts need bounded memory

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def pieces(text: str):
    """Arrays of bucket numbers of all subwords of a text, a piece of it at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0).astype(np.uint64)
    codes = np.concatenate([np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # one border between words
    codes = codes[keep]
    longest = max(ORDERS)
    for start in range(0, len(codes), PIECE):
        part = codes[start:start + PIECE + longest - 1]
        found = []
        for n in ORDERS:
            size = min(PIECE, len(part) - n + 1)
            if size <= 0:
                continue
            value, good = np.full(size, n, dtype=np.uint64), np.ones(size, dtype=bool)
            for j in range(n):
                letter = part[j:j + size]
                value = (value ^ letter) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
                if n == 1 or 0 < j < n - 1:
                    good &= letter != 0
            if n == 2:
                good &= (part[:size] != 0) | (part[1:1 + size] != 0)
            found.append((value[good] % np.uint64(BUCKETS)).astype(np.int64))
        yield np.concatenate(found) if found else np.zeros(0, np.int64)


def bucket_counts(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in pieces(text):
        counts += np.bincount(part, minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """Fitted tables: score of every bucket for every language, temperature, rejection level."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 2):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.table = np.zeros((BUCKETS, max(1, len(self.langs))), dtype=np.float32)
        self.temperature, self.level = 1.0, 0.0
        if not self.langs:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        back = order[: len(rows) // 5] if len(rows) >= 20 else order[:0]
        fit = order[len(back):]
        label = np.array([self.langs.index(lang) for lang, _, _ in rows])
        share = [c / c.sum() for _, _, c in rows]
        inner = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION))
        outer = rng.normal(0, 1 / DIMENSION, (DIMENSION, len(self.langs)))
        steps, step = EPOCHS * len(fit), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(fit):
                at, w = rows[i][1], share[i]
                if step % 2:  # every other time as if the text were short
                    at = rng.choice(at, size=min(len(at), 24), p=w)
                    w = np.full(len(at), 1 / len(at))
                rate = RATE * (1 - step / steps)
                step += 1
                hidden = w @ inner[at]
                logits = hidden @ outer
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label[i]] -= 1
                back_ = outer @ p
                outer -= rate * np.outer(hidden, p)
                # a row of the table gets a small share of each text's gradient, hence the larger step
                np.add.at(inner, at, -rate * SPREAD * w[:, None] * back_[None, :])
        self.table = (inner @ outer).astype(np.float32)
        # calibrated on whole texts and on short draws from them alike
        check, seen = [], []
        for i in back if len(back) else fit:
            check += [i, i, i]
            seen.append(share[i] @ self.table[rows[i][1]])
            for size in (24, 6):
                at = rng.choice(rows[i][1], size=size, p=share[i])
                seen.append(self.table[at].mean(axis=0))
        logits = np.array(seen)
        losses = {}
        for t in np.geomspace(0.1, 10, 41):
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            losses[t] = -(z[np.arange(len(check)), label[check]] - np.log(np.exp(z).sum(axis=1))).mean()
        self.temperature = float(min(losses, key=losses.get))
        sure = self._soft(logits)
        right = sure.argmax(axis=1) == label[check]
        self.level = float(np.quantile(sure.max(axis=1)[right], REJECT)) if right.any() else 0.0

    def _soft(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        total, count = np.zeros(len(self.langs)), 0
        for part in pieces(text):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            count += len(part)
        p = self._soft(total / max(1, count))
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.level)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of (doc_id, text, lang) rows with a language and at least one letter.

    ``sample`` texts per language, those with the smallest hashed ids, are used, whole. Their
    bucket counts, at most BUCKETS numbers a text, go to the driver.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # the ids are chosen first, so that no other text is moved
    chosen = first_per_key(usable.select("doc_id", "lang", F.xxhash64("text").alias("h")), "lang", ["doc_id", "h"], sample)
    chosen = F.broadcast(chosen.select("doc_id", "h").distinct())
    picked = usable.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"], "left_semi")
    schema = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])

    def count(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            counts = bucket_counts(text)
            at = np.nonzero(counts)[0]
            out.append((at.astype(np.int32), np.minimum(counts[at], 2**31 - 1).astype(np.int32)))
        return pd.DataFrame(out, columns=["at", "n"])

    rows = picked.select("lang", "doc_id", "h", F.pandas_udf(count, schema)(F.col("text")).alias("c")).select(
        "lang", "doc_id", "h", "c.at", "c.n").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("h", "ascending")])
    lists = lambda c: [np.asarray(x.values) for x in rows[c]]
    return Model([(lang, at, n.astype(float)) for lang, at, n in zip(
        rows["lang"].to_pylist(), lists("at"), lists("n")) if len(at)])


PREDICTED = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict_column(text: Column, model: Model, spark) -> Column:
    """Struct (lang, score, rejected); the model has BUCKETS rows, whatever the data."""
    shared = spark.sparkContext.broadcast(model)
    run = lambda texts: pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score", "rejected"])
    return F.pandas_udf(run, PREDICTED)(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``.

    Learned from the rows that are not held out and have a language; a prediction sees the text
    only. A text that is null or has no letter is ``und`` with score 0, as is every text if no
    language can be learned. Equal texts get equal predictions; other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                      predict_column(F.col("text"), model, docs.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")
