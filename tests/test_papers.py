"""Paper structure on hand-made text."""

from pyspark.sql import functions as F

from qamill.operators import concepts as cp
from qamill.operators import papers as pa

T = F.col("t")
PAPER = """Deep Things About Models
Ann Lee, Bo Ray* and Cy (2) ann@x.org
Abstract
We study things. They are deep.

Keywords: deep things; models, data

1. Introduction
Figure 1 shows it [1, 2]. See [3] and (Smith et al., 2020; Lee, 2021).
Figure 1: The plan of work.
2.1. Method
Table 2. All the numbers. In Tab. 2 and table 2 we list.
References
[1] A. Author. 2020. Some title. Journal, 1(2), 3-4.
[2] B. Author and C. Other (2021). Second
title. Proc, 5(6), 7-8. doi: 10.1/x.
Appendix
More."""


def test_front_matter(one):
    assert one(pa.title(T), t=PAPER) == "Ann Lee, Bo Ray* and Cy (2) ann@x.org"
    assert one(pa.title(T), t="a long first line\nshort\na long second 1") == "a long first line"
    assert one(pa.authors(T), t=PAPER) == ["Ann Lee", "Bo Ray"]  # "Cy" is too short
    assert one(pa.authors(T), t="Title\nAnn Lee, Bo Ray* and Cy Moe (2) c@x.org\nAbstract") == ["Ann Lee", "Bo Ray", "Cy Moe"]
    assert one(pa.authors(T), t="Title\nAbstract\nA, B") == []
    assert one(pa.keywords(T), t=PAPER) == ["deep things", "models", "data"]
    assert one(pa.abstract(T), t=PAPER) == "We study things. They are deep."
    assert one(pa.abstract(T), t="x\nAbstract\nonly one line.\nMore here.\nIntroduction\nno") == "only one line. More here."
    assert one(pa.abstract(T), t="nothing") == ""


def test_sections(one):
    got = one(pa.sections(T), t=PAPER)
    heads = [(s["heading"], s["level"]) for s in got]
    assert ("Abstract", 1) in heads and ("1. Introduction", 1) in heads and ("2.1. Method", 2) in heads
    for s, after in zip(got, got[1:]):
        assert PAPER[s["start_offset"]:s["end_offset"]].strip() == s["content"]
        assert s["end_offset"] <= after["start_offset"]
    alone = one(pa.sections(T), t="no heading here, at all.")
    assert [(s["heading"], s["start_offset"], s["end_offset"]) for s in alone] == [("Main Content", 0, 24)]


def test_captions_are_listed_once(one):
    fig = one(pa.captions(T, "figure"), t=PAPER)
    # "Figure 1 shows it [1, 2]." also has the caption form
    assert [f["number"] for f in fig] == ["1", "1"] and fig[0]["reference_count"] == 1
    assert fig[1]["caption"] == "Figure 1: The plan of work." and PAPER[fig[1]["position"]:].startswith("Figure 1: The")
    tab = one(pa.captions(T, "table"), t=PAPER)
    assert [(t["caption"], t["number"], t["reference_count"]) for t in tab] == [
        ("Table 2. All the numbers.", "2", 2), ("Tab. 2 and table 2 we list.", "2", 2)]


def test_references(one):
    region = one(pa.bibliography(T), t=PAPER)
    assert region.startswith("[1] A. Author") and "Appendix" not in region
    refs = one(pa.split_references(T), t=region)
    assert [r["id"] for r in refs] == ["1", "2"] and refs[1]["text"].startswith("B. Author and C. Other (2021). Second\ntitle")
    by_author = one(pa.split_references(T), t="Lee, A. and Ray, B. One thing.\nMoe, C. and Poe, D. Two things.")
    assert [r["id"] for r in by_author] == ["1", "2"] and by_author[1]["text"].startswith("Moe")
    by_line = one(pa.split_references(T), t="1. First entry\ncontinued\n2. Second entry")
    assert [r["text"] for r in by_line] == ["1. First entry continued", "2. Second entry"]
    assert one(pa.bibliography(T), t="no list, here.") == ""


def test_reference_fields_keep_the_year(one):
    p = one(pa.parse_reference(T), t="A. Author and C. Other, 2020, Some title. Journal, 1(2), 3-4. https://x.org/a.")
    assert p["year"] == "2020" and p["url"] == "https://x.org/a"
    p = one(pa.parse_reference(T), t="[7] Lee and Ray. (2021). Second title. Proc, 5(6), 7-8. doi: 10.1/x.")
    assert (p["authors"], p["year"], p["doi"]) == (["Lee", "Ray"], "2021", "10.1/x")
    assert one(pa.parse_reference(T), t="nothing")["year"] is None


def test_citations(one):
    got = one(pa.citations(T), t=PAPER)
    assert [c["ref_ids"] for c in got] == [["1", "2"], ["3"], ["1"], ["2"], ["Smith et al., 2020", "Lee, 2021"]]
    for c in got:
        assert PAPER[c["position"]:].startswith(c["text"])
        assert c["context"] == PAPER[max(0, c["position"] - 50):c["position"] + len(c["text"]) + 50]


def test_dangling_citations(spark):
    cited = spark.createDataFrame([("p", 3, ["1", "9"])], "paper_id string, position int, ref_ids array<string>")
    bib = spark.createDataFrame([("p", "1", "ref")], "paper_id string, id string, text string")
    got = {r["id"]: r["reference"] for r in pa.link_citations(cited, bib).collect()}
    assert got == {"1": "ref", "9": None}


def test_lines_follow_the_anchor(spark):
    words = [("p", 1, t, float(top), top + 5.0, float(x), x + 4.0) for t, top, x in [
        ("a", 0, 0), ("b", 2, 10), ("c", 4, 20), ("d", 6, 30), ("e", 20, 0)]]
    df = spark.createDataFrame(words, "paper_id string, page int, text string, top double, bottom double, x0 double, x1 double")
    got = [(r["line_ix"], r["text"], r["bottom"], r["x1"]) for r in pa.words_to_lines(df).orderBy("line_ix").collect()]
    # drift of 2 per word: the third word is 4 from the anchor and starts a line
    assert got == [(0, "a b", 7.0, 14.0), (1, "c d", 11.0, 34.0), (2, "e", 25.0, 4.0)]


def test_lines_of_long_and_odd_pages(spark):
    """A page of very many lines, whose words are not gathered, and pages with nulls and values without order."""
    long = spark.range(30_000).selectExpr(
        "'p' AS paper_id", "1 AS page", "concat('w', id) AS text", "CAST(id DIV 2 * 10 AS DOUBLE) AS top",
        "CAST(id AS DOUBLE) AS x0", "CAST(id + 1 AS DOUBLE) AS x1", "CAST(id DIV 2 * 10 + 5 AS DOUBLE) AS bottom")
    lines = pa.words_to_lines(long)
    assert "collect_list" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = {r["line_ix"]: (r["text"], r["top"], r["x0"], r["x1"]) for r in lines.collect()}
    assert got == {i: (f"w{2 * i} w{2 * i + 1}", 10.0 * i, 2.0 * i, 2.0 * i + 2) for i in range(15_000)}
    nan, inf = float("nan"), float("inf")
    odd = [(None, None, "a", None, 0.0, 1.0, 2.0), (None, None, "b", None, 0.0, 1.0, 2.0),
           ("q", 2, None, 1.0, 0.0, 1.0, None), ("q", 2, None, 1.5, 1.0, 2.0, 3.0), ("q", 2, "c", 2.0, 2.0, None, nan),
           ("q", 2, None, 9.0, 0.0, 1.0, None), ("q", 2, "d", nan, 0.0, 1.0, 1.0), ("q", 2, "e", nan, 0.0, 1.0, 1.0),
           ("q", 2, "f", inf, 0.0, 1.0, 1.0), ("q", 2, "g", inf, 0.0, 1.0, 1.0), ("q", 3, "h", 9.0, 0.0, 1.0, 1.0)]
    rows = spark.createDataFrame(odd, "paper_id string, page int, text string, top double, x0 double, x1 double, bottom double")
    got = sorted((str(r["paper_id"]), str(r["page"]), r["line_ix"], r["text"], r["x1"], str(r["bottom"])) for r in pa.words_to_lines(rows).collect())
    assert got == [("None", "None", 0, "a", 1.0, "2.0"), ("None", "None", 1, "b", 1.0, "2.0"), ("q", "2", 0, " c", None, "nan"),
                   ("q", "2", 1, None, 1.0, "None"), ("q", "2", 2, "f", 1.0, "1.0"), ("q", "2", 3, "g", 1.0, "1.0"),
                   ("q", "2", 4, "d", 1.0, "1.0"), ("q", "2", 5, "e", 1.0, "1.0"), ("q", "3", 0, "h", 1.0, "1.0")]


def test_full_text_skips_empty_pages(spark):
    df = spark.createDataFrame([("p", 2, "two"), ("p", 1, "one"), ("p", 3, ""), ("p", 4, None)], "paper_id string, page int, text string")
    row = pa.full_text(df).first()
    assert row["full_text"] == "one\n\ntwo" and row["first_page"] == "one"


def test_grid_records_and_attachment(spark):
    grid = [["a ", None, "a"], ["1", "2", None], ["", None, " "], ["x", "y", "z"]]
    grids = spark.createDataFrame([("p", 1, 1, grid), ("p", 2, 1, grid), ("p", 2, 5, grid), ("p", 3, 2, [["h"]])],
                                  "paper_id string, page int, table_ix int, grid array<array<string>>")
    rows = grids.select(pa.grid_records(F.col("grid")).alias("r")).first()["r"]
    assert rows == [{"Column_1": "2", "a": ""}, {"Column_1": "y", "a": "z"}]
    caps = spark.createDataFrame([("p", "1", 5, "Table 1: x.", 0), ("p", "2", 9, "Table 2: y.", 3)],
                                 "paper_id string, number string, position int, caption string, reference_count int")
    got = {r["table_id"]: (r["caption"], r["data"] is not None) for r in pa.attach_tables(caps, grids).collect()}
    assert got == {"table_1": ("Table 1: x.", True), "table_2": ("Table 2: y.", False),
                   "extracted_table_p2_1": ("Extracted Table 3", True), "extracted_table_p2_5": ("Extracted Table 4", True)}


def test_concepts(spark):
    sections = [("Intro", "Graph Nets are good. We use Graph Nets for Deep work. graph nets rock. the big plan, the big plan, the big plan"),
                ("References", "Graph Nets. Zed Zed. the big plan")]
    df = spark.createDataFrame([("p", [{"heading": h, "content": c} for h, c in sections])],
                               "paper_id string, sections array<struct<heading:string,content:string>>")
    got = {r["text"]: r for r in cp.concepts(df).collect()}
    assert got["Graph Nets"]["type"] == "entity" and got["Graph Nets"]["count"] == 2
    assert [e["section"] for e in got["Graph Nets"]["examples"]] == ["Intro", "Intro"]
    assert "graph nets" not in got and got["the big plan"]["count"] == 4 and "Zed Zed" not in got
    nested = cp.with_concepts(df).first()["concepts"]
    assert nested[0]["type"] == "entity"


def test_terms_are_counted_in_one_reading(spark):
    """Counts and edges of terms as the plain rules give them, also without words; no sorted array of all runs."""
    texts = ["The big cat. the BIG cat, the big cat ab ab ab ab", "x y", "", None]
    rows = [(str(i), None if t is None else [{"heading": "H", "content": t}]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "paper_id string, sections array<struct<heading:string,content:string>>")
    got = {(r["paper_id"], r["text"], r["count"]) for r in cp.terms(df).collect()}
    assert got == {("0", "the big", 3), ("0", "big cat", 3), ("0", "the big cat", 3), ("0", "ab ab", 3)}
    assert {r["text"] for r in cp.terms(df, edges=["the"]).collect()} == {"big cat", "ab ab"}
    assert "array_sort" not in cp.terms(df)._jdf.queryExecution().optimizedPlan().toString()


def test_terms_hold_one_paper_at_a_time():
    """A batch has up to 10,000 papers: their words must not all be Python strings at once."""
    import tracemalloc

    import pyarrow as pyarrow_

    rows = [[f"{i}w{j}" for j in range(2000)] for i in range(200)] + [None, [], ["so", "so"] * 4]
    tokens = pyarrow_.array(rows, pyarrow_.list_(pyarrow_.string()))
    del rows
    tracemalloc.start()
    out = cp._counted(tokens, 3, frozenset())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    assert out.to_pylist()[:-1] == [[]] * 202
    assert out.to_pylist()[-1] == [{"text": " ".join(["so"] * n), "count": 9 - n} for n in (2, 3, 4)]
