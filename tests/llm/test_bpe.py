import hashlib
import random

import pytest
import public_tokenizers
from llm_cases import messy, nothing, rows_of  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qamill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Coder(file.read()), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    coder, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == ids
    assert coder.decode(coder.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_runs_and_special_tokens(both):
    coder, library = both
    rng = random.Random(6)
    parts = ["<|endoftext|>", "ab", "aaaa", "  ", "\n\n", "1234", "'ll", "###", "ß", " ", "​", "<|", "endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_piece_is_linear(both):
    coder, library = both
    text = "ab" * 50_000 + "z" * 100_000
    assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_to_the_replacement_character(both):
    coder, library = both
    ids = coder.encode("漢")[:1]
    assert coder.decode(ids) == library.decode(ids.tolist()) == "�"


def test_cache_may_overflow(both, monkeypatch):
    coder, library = both
    monkeypatch.setattr(bpe, "CACHE", 3)
    text = "a few different words go here and there and here"
    assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_messy_rows(messy, nothing, both):
    library = both[1]
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(messy.select("doc_id", "text"))}
    rows = rows_of(bpe.digest_columns(bpe.encode_documents(messy, PATH)))
    assert len(rows) == messy.count()
    for row in rows:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
    assert bpe.digest_columns(bpe.encode_documents(nothing, PATH)).count() == 0
