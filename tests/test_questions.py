"""Question generation, validation, gold."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from qamill.operators import catalogue as cat
from qamill.operators import gold as go
from qamill.operators import questions as qu
from qamill.operators import validation as va
from qamill.session import materialise

T = F.col("t")
KIND = ("paper_id string, title string, abstract string, sections array<struct<heading:string,content:string>>, "
        "concepts array<struct<text:string,type:string,count:bigint,examples:array<struct<section:string,context:string>>>>")


def paper(spark, paper_id="p1"):
    sections = [
        ("1. Introduction", "Graph Nets are strong. Trees are slow. In robotics, Graph Nets refers to a family of models. End."),
        ("2. Method", "We propose a fast graph method to learn. Our novel sampling technique helps. It runs."),
        ("3 Results", "Accuracy was 93%. There is a 12% improvement over Trees. Results show that it works, well."),
        ("Experiment", "We find that Graph Nets beat Trees."),
    ]
    concepts = [("Graph Nets", "entity", 5, [("1. Introduction", "about Graph Nets")]), ("Trees", "entity", 3, []),
                ("message passing", "technical_term", 3, [])]
    return spark.createDataFrame([(paper_id, "A Title", "About nets.", sections, concepts)], KIND)


def test_components(spark):
    r = qu.components(paper(spark)).first()
    assert r["entities"] == ["Graph Nets", "Trees"] and r["domain"] == "robotics" and r["has_experiment"]
    assert any("graph method" in m for m in r["methods"]) and r["processes"] == ["We propose a fast graph method to learn."]
    assert r["metrics"] == ["Accuracy"] and len(r["results"]) == 2 and len(r["key_sentences"]) == 4
    held = paper(spark).select(qu.section_map(F.col("sections")).alias("m")).first()["m"]
    assert set(held) == {"1. introduction", "2. method", "3 results", "experiment"}


def test_phrases(one):
    assert one(qu.process_phrase(T), t="Here we propose a fast thing, see.") == "a fast thing"
    assert one(qu.process_phrase(T), t="Nothing.") == "the described process"
    assert one(qu.finding_phrase(T), t="We show that a, b work. So") == "a, b work"
    assert one(qu.improvement_phrase(T), t="a 12.5% improvement here") == "12.5% improvement"
    assert one(qu.improvement_phrase(T), t="a modest increase here") == "modest increase"


def plain_quota(total):
    counts = {t: round(total * s) for t, s in cat.TYPE_SHARES.items()}
    rest = total - sum(counts.values())
    order = sorted(counts) if rest > 0 else sorted(counts, key=lambda k: -counts[k])
    for t in order[:abs(rest)]:
        counts[t] += 1 if rest > 0 else -1
    return counts


def test_quotas_match_plain_rounding(spark):
    df = spark.range(0, 130).select("id", qu.quotas(F.col("id").cast("int")).alias("q"))
    for r in df.collect():
        assert r["q"] == plain_quota(r["id"]) and (r["id"] < 2 or sum(r["q"].values()) == r["id"])


def test_slots_and_validity(one):
    assert one(qu.template_slots(T), t="a {x} and {y z}") == ["x", "y z"]
    for text, ok in [("What is it here?", True), ("What is [slot] here?", False), ("Too few?", False), ("No mark at all", False)]:
        assert one(qu.is_valid(T), t=text) is ok


def test_question_id(one):
    assert one(qu.question_id(T), t="When was Stockmeyer first introduced?") == "q_698feef5879a"


def test_fill_uses_the_paper(spark):
    rows = qu.instantiate(qu.components(paper(spark)), variants=3).collect()
    for r in rows:
        assert "{" not in r["question"]
        text = r["template"]
        for slot in re.findall(r"\{([^}]+)\}", text):
            text = text.replace("{" + slot + "}", r["template_slots"][slot])
        assert text == r["question"]
        slots = r["template_slots"] or {}
        if "concept1" in slots:
            assert slots["concept1"] != slots["concept2"]
        if "entity" in slots:
            assert slots["entity"] in ("Graph Nets", "Trees")
        if "entities" in slots:
            assert slots["entities"] == "[entities]"
    again = qu.instantiate(qu.components(paper(spark)), variants=3).collect()
    assert rows == again


def test_generate(spark):
    papers = paper(spark).unionByName(paper(spark, "p2"))
    rows = qu.generate(papers, 12).collect()
    texts = [r["question"] for r in rows]
    assert len(texts) == len(set(texts))
    for p in ("p1", "p2"):
        assert 0 < len([r for r in rows if r["paper_id"] == p]) <= 12
    for r in rows:
        assert r["complexity"] in ("L1", "L2", "L3") and r["contexts"] is not None
        assert ("impossible" in r["special_categories"]) == (r["answer"] == cat.NOT_POSSIBLE)
        if r["query_type"] == "procedural":
            assert [c["section"] for c in r["contexts"]] == ["Abstract", "2. Method"]
    seeds = qu.seed_questions(qu.candidates(papers), 1).collect()
    assert len({(r["paper_id"], r["query_type"]) for r in seeds}) == len(seeds)


def test_questions_are_filled_once_before_their_contexts(spark):
    """Contexts need the questions several times; their fillings are written, not made again each time."""
    papers = paper(spark)
    stored = []
    made = qu.generate(papers, 6, store=lambda rows, name: (stored.append(name), materialise(rows, name))[1])
    assert "chosen" in stored
    assert "slot_values" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 6


def test_around(one):
    text = "First one. Second with term inside it! Third."
    assert one(qu.around(T, F.lit("term"), 3), t=text) == "Second with term inside it!"
    assert one(qu.around(T, F.lit("TERM"), 3), t=text) == "Second with term inside it!"
    assert one(qu.around(T, F.lit("absent"), 3), t=text) == ""


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=12))
def test_shorten(lengths):
    text = " ".join("y" * n + "." for n in lengths)
    out = ""
    for n in lengths:
        if len(out) + n + 1 > 500:
            break
        out += "y" * n + ". "
    spark = SparkSession.getActiveSession()
    got = spark.createDataFrame([(text,)], "t string").select(qu.shorten(T).alias("x")).first()["x"]
    assert got == (text if len(text) <= 500 else out.strip())


def lookup(spark, expression):
    return paper(spark).select(expression.alias("x")).first()["x"]


def test_definitions_and_comparisons(spark):
    sections = F.col("sections")
    for term in ("Graph Nets", "graph nets"):
        assert lookup(spark, qu.definition(F.lit(term), sections)) == "In robotics, Graph Nets refers to a family of models."
    assert lookup(spark, qu.definition(F.lit("sampling"), sections)) == "Our novel sampling technique helps."
    assert lookup(spark, qu.definition(F.lit("a.b(c"), sections)) is None
    assert lookup(spark, qu.comparison(F.lit("graph nets"), F.lit("trees"), sections)) == "Graph Nets are strong. Trees are slow."
    assert lookup(spark, qu.comparison(F.lit("graph"), F.lit("learn"), sections)) == "We propose a fast graph method to learn."
    assert lookup(spark, qu.comparison(F.lit("propose"), F.lit("runs"), sections)).startswith("We propose")
    assert lookup(spark, qu.comparison(F.lit("zzz"), F.lit("trees"), sections)) is None


def test_validation_statuses(spark):
    rows = [(1, "What is a good question?", "x" * 20, "factoid", "L1"), (2, "Short?", "x" * 20, "factoid", "L1"),
            (3, "no mark", "short", None, "L1"), (4, "What is [slot] of it?", "x" * 30, "other", None)]
    got = {r["i"]: r for r in va.auto_validate(spark.createDataFrame(
        rows, "i int, question string, answer string, query_type string, complexity string")).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["approved", "needs_review", "rejected", "needs_review"]
    assert got[3]["issues"] == ["Question is too short", "Question does not contain a question mark", "Answer is too short", "Missing query type"]
    for r in got.values():
        failed = [c for c in ("clarity", "answer", "annotation") if not r["criteria"][c]]
        assert (r["status"] == "rejected") == (len(failed) == 3)


def test_search_terms(one):
    slots = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(v))])
    term = lambda q, m=None: one(go.search_term(T, m), t=q)
    assert term("What is it?", slots(entity="E", method="M")) == "E"
    assert term("How do big nets beat small nets today?") == "nets"
    assert term("What is the cat, dog?") == "cat"
    assert term("Is it so") == "Is it so"


def test_gold_answers(spark):
    rows = [("q1", "What is sampling about?", "ans", "p1", None), ("q2", "What of zebra?", None, "p1", None),
            ("q3", "Lost?", "a", "nowhere", None)]
    df = spark.createDataFrame(rows, "question_id string, question string, answer string, paper_id string, template_slots map<string,string>")
    df = df.withColumn("gold_answer", F.lit(None).cast(go.GOLD_TYPE))
    got = {r["question_id"]: r["gold_answer"] for r in go.generate_gold(df, paper(spark)).collect()}
    assert got["q1"]["text"] == "ans" and not got["q1"]["is_validated"]
    assert [(p["id"], p["text"]) for p in got["q1"]["supporting_passages"]] == [
        ("P1", "We propose a fast graph method to learn. Our novel sampling technique helps. It runs.")]
    assert got["q2"]["supporting_passages"] == [] and got["q3"] is None
    filled = {r["question_id"]: r["gold_answer"] for r in go.placeholder_gold(df).collect()}
    assert filled["q3"]["is_validated"] and filled["q3"]["text"].endswith("Lost?")


def test_passages_deduplicate_and_use_concepts(spark):
    df = spark.createDataFrame([("p1", "Graph Nets")], "paper_id string, term string")
    got = go.passages(df, paper(spark)).first()["passages"]
    texts = [p["text"] for p in got]
    assert len(texts) == len(set(texts)) and texts[-1] == "about Graph Nets"
    assert texts[0] == "Graph Nets are strong. Trees are slow."


def test_passages_against_plain_search(spark):
    """Many terms, some in each other, null, empty, repeated, over several lists of one paper."""
    rng = random.Random(3)
    syllables = ["ab", "abc", "bc", "x", "İ", "ß", "ab c"]
    sentence = lambda: " ".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))).capitalize() + rng.choice(".!?")
    papers = []
    for p in range(4):
        sections = [(rng.choice(["Intro", "References", "Method", "ACKNOWLEDGEMENTS"]), " ".join(
            sentence() for _ in range(rng.randint(0, 12)))) for _ in range(5)]
        papers.append((f"p{p}", sections, []))
    papers.append(("empty", [], []))
    papers.append(("nothing", None, None))
    terms = [None, "", "ab", "AB", "abc", "bc x", "c", "zz", ". "] + [f"t{i}" for i in range(600)]
    questions = [(n, f"p{n % 5}" if n % 7 else rng.choice(["empty", "nothing"]), t, "clash")
                 for n, t in enumerate(t for t in terms + terms[:9] * 4)] + [(9999, None, "ab", "clash")]
    kind = ("paper_id string, sections array<struct<heading string, content string>>, "
            "concepts array<struct<text string, examples array<struct<section string, context string>>>>")
    kind += ">" * (kind.count("<") - kind.count(">"))
    asked = spark.createDataFrame(questions, "n int, paper_id string, term string, sections string")
    got = go.passages(asked, spark.createDataFrame(papers, kind), limit=4)
    assert got.columns == ["n", "paper_id", "term", "sections", "passages"]

    def expected(paper, term):
        out = []
        for heading, content in dict((p[0], p[1]) for p in papers)[paper] or []:
            if term is None or re.search("reference|bibliography|acknowledgement", heading.lower()):
                continue
            parts = re.split(r"(?<=[.!?])\s+", content)
            for i, part in enumerate(parts):
                text = " ".join(parts[max(i - 1, 0):i + 2])
                if term.lower() in part.lower() and text not in [t for _, t in out]:
                    out.append((heading, text))
        return out[:4]

    rows = {r["n"]: [tuple(p) for p in r["passages"]] for r in got.collect()}
    known = {p[0] for p in papers}
    assert rows == {n: expected(p, t) for n, p, t, _ in questions if p in known}
    assert sum(map(len, rows.values())) > 50


def test_a_text_is_cut_once_for_a_list_of_questions(spark, monkeypatch):
    """Lists are bounded, also those of one paper with very many questions, equal ones among them."""
    asked = spark.range(5000).selectExpr("id DIV 2 AS n", "'p1' AS paper_id", "concat('t', id % 3) AS term")
    papers = spark.createDataFrame([("p1", [("A", "T0 here. T1 there. And t2.")], [])],
                                   "paper_id string, sections array<struct<heading string, content string>>, "
                                   "concepts array<struct<text string, examples array<struct<section string, context string>>>>")
    sizes = [r["n"] for r in go.in_lists(asked, papers).select(F.size("asked").alias("n")).collect()]
    assert sum(sizes) == 5000 and len(sizes) == 20 and max(sizes) <= go.TOGETHER
    monkeypatch.setattr(go, "LOT", 500)
    lists = go.in_lists(asked, papers)
    assert 20 <= lists.count() <= 40 and lists.select(F.sum(F.size("asked"))).first()[0] == 5000
    assert go.passages(asked, papers).where(F.size("passages") == 1).count() == 5000
