import random
import zlib

import numpy as np
from llm_cases import messy, nothing, prose, rows_of  # noqa: F401

from qamill.llm import registry, toxicity
from qamill.llm.common import table

LABELS = "doc_id long, toxic int"
BAD = ["grumble", "snarl", "vexing", "odious"]


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


def corpus(n, seed=1):
    """Documents of clean sentences, a third with one or two offending ones."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        sentences = [prose(1000 * i + k, 8) + "." for k in range(rng.randrange(1, 12))]
        toxic = int(i % 3 == 0)
        for _ in range(toxic * rng.randrange(1, 3)):
            sentences.insert(rng.randrange(len(sentences) + 1), f"{prose(i, 3)} {rng.choice(BAD)} {prose(i + 7, 2)} {rng.choice(BAD)}!")
        rows.append((i, " ".join(sentences)))
        labels.append((i, toxic))
    return rows, labels


def test_offending_sentences_are_learned_from_document_labels(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = rows_of(toxicity.judge(docs, spark.createDataFrame(labels, LABELS)))
    assert [r for r in judged if r["held_out"] != (fold(r["doc_id"]) == 1)] == []
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in judged if r["held_out"]]
    assert len(right) > 70 and np.mean(right) > 0.95
    texts = dict(rows)
    marked = [texts[r["doc_id"]][s["start"]:s["end"]] for r in judged for s in r["offending"]]
    assert len(marked) > 80 and all(any(b in m for b in BAD) for m in marked)


def test_score_is_the_noisy_or_of_its_sentences():
    model = toxicity.Model([], {})
    model.start = -2.0
    model.weights = {toxicity.features("bad")[0]: 3.0, toxicity.features("badly")[1]: 0.5}
    score, n, offending = toxicity.Scorer(model)("Bad bad day. Badly done! Fine\n... \n")
    chance = [1 / (1 + np.exp(-z)) for z in (1.0, -1.5, -2.0)]
    assert n == 3 and abs(score - (1 - np.prod([1 - c for c in chance]))) < 1e-12
    assert [(a, b) for a, b, _ in offending] == [(0, 12)] and abs(offending[0][2] - chance[0]) < 1e-12


def test_labels_of_held_out_documents_change_nothing(spark):
    rows, labels = corpus(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if fold(i) == 1 else t) for i, t in labels]
    scores = [{r["doc_id"]: r["score"] for r in rows_of(toxicity.judge(docs, spark.createDataFrame(x, LABELS)))} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_gradient_steps_raise_the_likelihood(monkeypatch):
    rows, labels = corpus(60)
    bags = [(t, toxicity.bag(text)) for (_, text), (_, t) in zip(rows, labels)]
    fit = [(t, np.concatenate(b), np.array([len(x) for x in b])) for t, b in bags]

    def loss(steps):
        monkeypatch.setattr(toxicity, "STEPS", steps)
        scorer = toxicity.Scorer(toxicity.Model(fit, {0: 1.0, 1: 1.0}))
        p = np.clip([scorer(text)[0] for _, text in rows], 1e-9, 1 - 1e-9)
        return -np.mean([np.log(x if t else 1 - x) for x, (_, t) in zip(p, labels)])

    assert loss(0) > loss(20) > loss(300)


def test_strange_rows(spark, messy, nothing):  # noqa: F811
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (6, 0), (9, None), (None, 1), (77, 1)] + [(100 + i, i % 2) for i in range(20)], LABELS)
    rows = rows_of(toxicity.judge(messy, labels))
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert all(r["score"] == 0 and r["n_sentences"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    same = [r["score"] for r in rows if r["doc_id"] in (5, 7)]
    assert same[0] == same[1]
    assert toxicity.judge(nothing, labels).count() == 0
    assert all(r["score"] < 0.7 for r in rows_of(toxicity.judge(messy, labels.limit(0))) if r["doc_id"] != 6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = rows_of(registry.op12_toxicity(spark, folder).join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id"))
    back = [r for r in rows if r["held_out"]]
    clean, toxic = [r for r in back if not r["toxic"]], [r for r in back if r["toxic"]]
    assert np.mean([r["predicted"] == 0 for r in clean]) > 0.97 and np.mean([r["predicted"] for r in toxic]) > 0.6
    assert np.mean([a["score"] < b["score"] for a in clean for b in toxic]) > 0.95
