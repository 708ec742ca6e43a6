"""Text functions and the decisions on tokens, rounding and picks."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qamill.functions import picks
from qamill.functions import text as tx

T = F.col("t")


def test_tokens_are_unicode(one):
    assert one(tx.tokens_strip(T), t="Été, naïve x_1!") == ["été", "naïve", "x_1"]
    assert one(tx.tokens_word(T), t="Été, naïve x_1!") == ["été", "naïve", "x_1"]


def test_two_tokenisers_differ(one):
    assert one(tx.tokens_strip(T), t="don't") == ["dont"]
    assert one(tx.tokens_word(T), t="don't") == ["don", "t"]


def test_clean(one):
    assert one(tx.clean(T), t="  a\n\tb  c ") == "a b c"
    assert one(tx.clean(T, drop_special=True), t="a #b, (c)! é-f") == "a b, c! é-f"


def test_sentences(one):
    assert one(tx.sentences(T), t="One two. Three?  Four!\nFive") == ["One two.", "Three?", "Four!", "Five"]


def test_jaccard(one):
    score = lambda a, b: one(tx.jaccard(F.array_distinct(tx.tokens_strip(F.lit(a))), F.array_distinct(tx.tokens_strip(F.lit(b)))))
    assert score("a b c", "b c d") == 0.5
    assert score("a", "") == 0.0
    assert score("A b!", "b a a") == 1.0


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab[]12 \né", max_size=60))
def test_spans_match_the_regex_engine(text):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    pattern = r"\[\d+\]|a+"
    got = spark.createDataFrame([(text,)], "t string").select(tx.spans(T, pattern).alias("x")).first()["x"]
    want = [(m.group(0), m.start(), m.end()) for m in re.finditer(pattern, text)]
    assert [tuple(r) for r in got] == want


def test_ngrams_and_short_input(one):
    toks = F.array(*[F.lit(x) for x in "abcd"])
    assert one(tx.ngrams(toks, 2)) == ["a b", "b c", "c d"]
    assert one(tx.ngrams(F.slice(toks, 1, 1), 2)) == []


def test_count_plain_and_quoted(one):
    assert one(tx.count_plain(T, F.lit("aa")), t="aaaa a") == 2
    assert one(F.call_function("regexp_extract", T, tx.quoted(F.lit("a.(b")), F.lit(0)), t="x a.(b y") == "a.(b"


def test_picks_come_from_md5(one):
    want = int(hashlib.md5(b"42:k:s").hexdigest()[:8], 16)
    assert one(picks.draw(42, F.lit("k"), "s")) == want
    assert one(picks.draw(F.lit("a"))) == 214005177
    assert one(picks.weighted([("x", 0.5), ("y", 0.5)], F.lit(0.5))) == "y"
    assert one(picks.choose(F.array().cast("array<string>"), 1)) is None
