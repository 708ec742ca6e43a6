"""The one-pass page reader on every kind of token, and in time linear in the page."""

import html as entities
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qamill.operators import markup as mk

CASES = {
    "": "", "plain": "plain", "a < b > c <3 <": "a < b > c <3 <", "x<b>y</b>z": "xyz", "<p>a<p>b": "a\nb", "a<br>b<BR/>c": "a\nb\nc",
    '<a title="x > y" href=z>t</a>': "t", "<a title='\"> >'>t</a>": "t", "<p don't>it's</p>": "it's", "<a b = 'c>d' e>f": "f",
    "<a href=it's>a</a> b'>c": "a b'>c", "<a title=\"open>rest": "", "<p": "", "a</": "a", "a</>b</ x>c": "abc", "<1>": "<1>",
    "a<!-- > <p> -->b": "ab", "a<!-->b": "ab", "a<!--->b": "ab", "a<!-- open": "a", "<!DOCTYPE html>a<?php x ?>b": "ab",
    "<script>a < b; '</p>' </script>c": "c", "<SCRIPT x='>'>a</script >c": "c", "<script>open": "", "<style>p>a{}</styles></style>b": "b",
    "<title>t</title><body>b": "b", "<textarea><i>&lt;</textarea>b": "<i><b", "<xmp>&lt;<b></xmp>c": "&lt;<b>c",
    "<noscript>n</noscript><template><p>t</p></template>c": "c", "</script>a": "a", "<scripted>a": "a",
    "&amp;lt; &lt;b&gt; &#65;&#x42;&nbsp;&hellip; &copy &unknown; &#0;&#x110000;": "&lt; <b> AB … © &unknown; ��",
    "<pre>a  b\n\n c</pre>  d": "a b\nc\nd", "é<bé>ü</bé>": "éü",
}


def test_cases():
    for page, text in CASES.items():
        assert mk.plain(page) == text, page
    assert mk.plain(None) is None


def test_rows(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*CASES, None])], "i int, p string")
    got = {r["i"]: r["t"] for r in rows.select("i", mk.page_text("p").alias("t")).collect()}
    assert got == {i: t for i, t in enumerate([*CASES.values(), None])}
    assert rows.limit(0).select(mk.page_text("p")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "bold", "comment", "script", "quoted"]), st.text("ab<>&'\"= ", max_size=8)), max_size=8))
def test_escaped_text_is_read_back(parts):
    page, seen = "", ""
    for kind, text in parts:
        safe = entities.escape(text, quote=True)
        if kind == "text":
            page, seen = page + safe, seen + text
        elif kind == "bold":
            page, seen = page + f'<b class="{safe.replace("&gt;", ">")}">{safe}</b>', seen + text
        elif kind == "comment":
            page += f"<!-- {text} -->"
        elif kind == "script":
            page += f"<script>{text}</script>"
        else:
            page += f"<i a='{text.replace(chr(39), '')}'></i>"
    assert mk.plain(page) == " ".join(x for x in seen.split(" ") if x)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/!-ab='\"& \n", max_size=60))
def test_any_text_ends(page):
    mk.plain(page)


def test_time_grows_with_the_page():
    for unit in ["<", "<!--", "<a b='", "<p a=\"x\" ", "</", "&#", "<script>", "a<b ", "<!", "\n ", "< "]:
        started = time.time()
        mk.plain(unit * 200_000)
        assert time.time() - started < 5, unit
