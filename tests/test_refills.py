from pyspark.sql import functions as F
from test_questions import KIND

from qamill.operators import fillings as fl
from qamill.operators import questions as qu

TEMPLATES = {"factoid": ["What is meant by {concept}?"]}


def papers(spark, sizes):
    return spark.createDataFrame([(p, "A Title", "About.", [("1. Introduction", "Text.")], [
        (f"net {i}", "entity", 1, []) for i in range(n)]) for p, n in sizes.items()], KIND)


def test_refills_go_on_until_nothing_is_new(spark):
    rows = qu.generate(papers(spark, {"p1": 300}), 300, TEMPLATES).collect()
    assert len({r["question"] for r in rows}) == len(rows) == 300


def test_shortfall_tells_the_cause(spark):
    both = papers(spark, {"p1": 8, "p2": 8, "p3": 3})
    made = qu.generate(both, 6, TEMPLATES)
    own = qu.candidates(both, TEMPLATES, 100, scope="paper")
    assert made.count() == 8
    cause = {r["paper_id"]: r["cause"] for r in qu.shortfall(made, both, 6, own).collect()}
    assert cause["p3"] == "used_up" and set(cause.values()) == {"used_up", "taken"}
    assert qu.shortfall(made, both, 6).columns == ["paper_id", "found", "missing"]


def test_a_filling_reads_the_shape_of_its_template(spark):
    """What a slot has to skip is found once per paper and template, not at every turn of every filling."""
    templates = {"comparative": ["How do {concept1} and {concept2} differ?", "{concept2} or {concept1}, and {method}?"]}
    rows = fl.offers(qu.components(papers(spark, {"p1": 5, "p2": 1})), templates, qu.PHRASES, 42).localCheckpoint()
    both = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda v: F.struct(
        fl.question(F.get("shapes", v % 2), v, 42).alias("text"), fl.fill(F.get("shapes", v % 2), v, 42).alias("whole")))
    made = rows.withColumn("shapes", fl.shaped(templates)).select("paper_id", F.explode(both).alias("b")).select("paper_id", "b.*").collect()
    assert all(r["text"] == r["whole"]["question"] for r in made)
    assert len({r["text"] for r in made if r["paper_id"] == "p1" and r["whole"]["template_ix"] == 0}) == 10
    plan = qu.instantiate(qu.components(papers(spark, {"p1": 5})), templates)._jdf.queryExecution().analyzed().toString()
    assert plan.count("[12]$") <= 3  # 5 when every filling asked again
