"""Language identification and the Kneser-Ney classifier: held-out accuracy and a plain model."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import messy, nothing, prose, rows_of  # noqa: F401

from qamill.llm import kneser, langid, registry

MIDDLE = "/root/testdata/sf0.01"


def test_subwords_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "Straße, naïve 漢字 x " * 50
    whole = langid.bucket_counts(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.bucket_counts(text) == whole).all()
    assert langid.bucket_counts("").sum() == langid.bucket_counts(" 12 ").sum() == 0


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in rows_of(spark.read.parquet(f"{MIDDLE}/documents.parquet"))}
    rows = rows_of(registry.queries()["op2_language_id"](spark, MIDDLE))
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    langs = {d["lang"] for d in docs.values()} - {None}
    right = []
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] in langs
            if r["held_out"]:
                right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert np.mean(right) > 0.97


def test_languages_of_messy_rows(messy, nothing):
    rows = rows_of(langid.identify(messy))
    assert len(rows) == messy.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert langid.identify(nothing).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in rows_of(langid.identify(docs))} == {"und"}


def plain_model(texts, numbers):
    """Interpolated modified Kneser-Ney by dictionaries, from the definition."""
    tri = Counter()
    for text in texts:
        tri.update(zip(*[kneser._codes(text, kneser.Codes(numbers)).tolist()[i:] for i in range(3)]))
    bi, uni = Counter(), Counter()
    for _, b, c in tri:
        bi[b, c] += 1
    for _, c in bi:
        uni[c] += 1

    def order(counts):
        n = Counter(counts.values())
        if all(n[i] for i in (1, 2, 3)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [0] + [min(float(k), max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3)]
        else:
            d = [0, 0.5, 0.5, 0.5]
        total, held = defaultdict(float), defaultdict(float)
        for key, c in counts.items():
            total[key[:-1]] += c
            held[key[:-1]] += d[min(c, 3)]
        return counts, d, total, held

    orders = [order({(c,): v for c, v in uni.items()}), order(bi), order(tri)]

    def p(gram):
        if not gram:
            return 1 / (len(uni) + 1)
        counts, d, total, held = orders[len(gram) - 1]
        h = gram[:-1]
        if h not in total:
            return p(gram[1:])
        c = counts.get(gram, 0)
        return (c - d[min(c, 3)]) / total[h] + held[h] / total[h] * p(gram[1:])
    return p, uni


def test_costs_equal_the_definition(spark):
    texts = [prose(i, 80) for i in range(40)]
    model = kneser.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    numbers = model.vocabulary["en"]
    assert len(numbers) > 10
    p, seen = plain_model(texts, numbers)
    for text in [prose(100 + i, 30) for i in range(10)]:
        codes = kneser._codes(text, kneser.Codes(numbers)).tolist()
        want = sum(-math.log(p(tuple(codes[i:i + 3])) if codes[i + 2] in seen else 1e-7) for i in range(len(codes) - 2)
                   if codes[i + 2] in seen)
        others = sum(1 for c in codes[2:] if 0 < c <= kneser.SHAPES)
        got, n = model.cost("en", text)
        unseen = [c for c in codes[2:] if c not in seen]
        if not unseen:
            assert got == pytest.approx(want + others * model.rare.get("en", 0.0), rel=1e-5)
        assert n == 30


def test_probabilities_add_up(spark):
    texts = [prose(i, 60) for i in range(30)]
    model = kneser.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    p, uni = plain_model(texts, model.vocabulary["en"])
    one = next(iter(model.vocabulary["en"].values()))
    assert sum(p((one, one, c)) for c in uni) == pytest.approx(1.0, abs=0.02)


def test_quality_query(spark):
    rows = {r["doc_id"]: r for r in rows_of(registry.queries()["op9_quality"](spark, MIDDLE))}
    labels = rows_of(spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    good = [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]]["keep"] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.35


def test_quality_of_messy_rows(messy, nothing, spark):
    ids = messy.select("doc_id").where("doc_id >= 100")
    rows = rows_of(kneser.judge(messy, ids))
    assert len(rows) == messy.count()
    assert not any(r["keep"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["keep"] for r in rows if r["lang"] in ("fr", "de"))  # no trusted text: no evidence
    assert kneser.keep_good(messy, ids).columns == messy.columns
    assert kneser.judge(nothing, ids).count() == 0
    rows = rows_of(kneser.judge(messy, ids.where("false")))
    assert all(r["keep"] == (r["doc_id"] not in (1, 2, 3)) for r in rows)
