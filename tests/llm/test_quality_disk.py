"""The quality model in packed blocks: nothing is lost in them, slices change no result, and little is left on disk."""

import os

import numpy as np
import pytest
from llm_cases import messy, prose, rows_of  # noqa: F401

from qamill.llm import kneser
from qamill.llm.packed import grouped, pack, unpack


def test_blocks_give_back_their_arrays():
    keys = np.array([0, 5, 2**40, 2**64 - 1], dtype=np.uint64)
    for arrays in ([keys, np.array([0, 300, 7])], [keys[:0], np.zeros(0, dtype=np.int64)], [np.zeros(4, dtype=np.int64), keys]):
        got = unpack(pack(*arrays))
        assert [g.tolist() for g in got] == [a.tolist() for a in arrays]
        assert [g.dtype for g in got] == [a.dtype for a in arrays]


def test_sums_by_key():
    keys, first, (sums,) = grouped(np.array([3, 1, 3, 1, 2]), np.array([1, 2, 3, 4, 5]))
    assert keys.tolist() == [1, 2, 3] and sums.tolist() == [6, 5, 4] and sorted(first // 2) == [0, 0, 2]


def test_words_are_split_as_bytes_are():
    texts = ["a b  c", " é\x0b漢字 x\n", "", None, "   ", "a\x1cb\x85c d", "　x y\xa0z"]
    grams = kneser.Grams(["en"] * len(texts), texts, kneser.Codes())
    assert grams.codes.tolist() == [c for t in texts for c in kneser._codes(t, kneser.Codes()).tolist()]
    assert grams.words.tolist() == [len(kneser.words(t)) for t in texts]


def test_slices_change_no_result(messy, monkeypatch):
    ids = messy.select("doc_id").where("doc_id >= 100")
    results = []
    for chunk, rounds, at_once in ((kneser.CHUNK, 1, 12), (3000, 3, 1)):
        monkeypatch.setattr(kneser, "CHUNK", chunk)
        monkeypatch.setattr(kneser, "ROUNDS", rounds)
        monkeypatch.setattr(kneser, "AT_ONCE", at_once)
        results.append(sorted(rows_of(kneser.judge(messy, ids)), key=str))
    assert len(results[0]) == len(results[1]) == messy.count()
    for a, b in zip(*results):
        assert {k: v for k, v in a.items() if k not in ("perplexity", "threshold")} == {
            k: v for k, v in b.items() if k not in ("perplexity", "threshold")}
        for k in ("perplexity", "threshold"):
            assert a[k] == b[k] if a[k] is None else a[k] == pytest.approx(b[k], rel=1e-9)


def test_the_model_is_gone_when_all_is_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("qamill.session.shared_dir", lambda spark: str(tmp_path))
    texts = [(i, prose(i, 400), "en") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert kneser.judge(docs, docs.select("doc_id")).count() == 300
    left = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet"))
    assert left < 0.2 * sum(len(t) for _, t, _ in texts)
    assert not any(t.name.startswith("ngrams") for t in spark.catalog.listTables() if os.path.exists(str(tmp_path / t.name)))
