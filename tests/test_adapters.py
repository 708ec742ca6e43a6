"""Files to readers to operators and back."""

import json

from qamill.operators import catalogue as cat
from qamill.operators import questions as qu
from qamill.operators import validation as va
from qamill.sources import adapters as ad
from qamill.sources import results, sinks


def test_questions_go_from_files_to_validation_and_back(spark, tmp_path):
    given = [{"question_id": "q1", "question": "What is the method?", "answer": "a", "paper_id": "p",
              "metadata": {"query_type": "factoid", "complexity": "L1", "special_categories": ["temporal"], "template_slots": {"x": "y"}}},
             {"question_id": "q2", "question": "Why?", "paper_id": "p", "metadata": {"query_type": "causal"}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text(json.dumps(given))
    read = results.read_questions(spark, str(tmp_path / "in"))
    flat = ad.flatten_questions(read)
    assert {"query_type", "template_slots", "special_categories"} <= set(flat.columns)
    assert va.auto_validate(flat).count() == 2
    nested = ad.nest_questions(flat.drop("source"))
    sinks.write_json(nested, str(tmp_path / "out"))
    again = ad.flatten_questions(results.read_questions(spark, str(tmp_path / "out"), lines=True))
    row = again.where("question_id = 'q1'").first()
    assert row["query_type"] == "factoid" and row["template_slots"] == {"x": "y"} and row["special_categories"] == ["temporal"]
    assert again.where("question_id = 'q2'").first()["special_categories"] == []


def test_papers_become_flat(spark, tmp_path):
    (tmp_path / "p7.json").write_text(json.dumps({
        "metadata": {"title": "T", "abstract": "A"}, "sections": [{"heading": "H", "content": "c"}, {"heading": "I", "content": "d"}]}))
    papers = results.read_papers(spark, str(tmp_path))
    assert ad.flatten_papers(papers).select("paper_id", "title", "abstract").first() == ("p7", "T", "A")
    assert ad.paper_text(papers).first()["full_text"] == "H\nc\n\nI\nd"


def test_responses_get_one_score(spark, tmp_path):
    question = {"question_id": "q", "question": "Q?", "paper_id": "p", "metadata": {"query_type": "factoid"}}
    body = {"system": {"name": "s"}, "timestamp": "2024-01-01T00:00:00", "responses": [
        {"question": question, "success": True, "score": 0.5}, {"question": question, "success": True, "evaluation": {"score": 0.25}},
        {"question": question, "success": True, "metrics": {"rouge": {"rougeL_fmeasure": 0.125}}}, {"question": question, "success": False}]}
    (tmp_path / "e.json").write_text(json.dumps(body))
    rows = ad.flatten_responses(results.read_evaluations(spark, str(tmp_path))).orderBy("question_ix").collect()
    assert [r["score"] for r in rows] == [0.5, 0.25, 0.125, None]
    assert {r["query_type"] for r in rows} == {"factoid"} and {r["question_id"] for r in rows} == {"q"}


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "factoid.txt").write_text("What is {concept}?\n\nWho made {concept}?\n")
    found = ad.templates(results.read_templates(spark, str(tmp_path)))
    assert found == {"factoid": ["What is {concept}?", "Who made {concept}?"]}
    assert ad.templates(results.read_templates(spark, str(tmp_path)).limit(0)) == cat.TEMPLATES
    papers = spark.createDataFrame(
        [("p", "", [("Intro", "Deep Net is here. Deep Net is good. Deep Net wins.")],
          [("Deep Net", "entity", 3, [])])],
        "paper_id string, abstract string, sections array<struct<heading:string,content:string>>, "
        "concepts array<struct<text:string,type:string,count:bigint,examples:array<struct<section:string,context:string>>>>")
    filled = qu.instantiate(qu.components(papers.selectExpr("*", "'t' AS title")), found)
    assert {r["question"] for r in filled.collect()} == {"What is Deep Net?", "Who made Deep Net?"}


def test_given_shares_replace_a_whole_dimension(spark, tmp_path):
    (tmp_path / "shares.json").write_text(json.dumps({"complexity": {"L1": 0.25, "L9": 0.75}}))
    found = {(r["dimension"], r["value"]): r["target"] for r in ad.targets(spark, ad.read_shares(spark, str(tmp_path))).collect()}
    assert {k for k in found if k[0] == "complexity"} == {("complexity", "L1"), ("complexity", "L9")}
    assert found["query_type", "factoid"] == cat.TYPE_SHARES["factoid"]
    assert len(ad.targets(spark).collect()) == sum(len(s) for s in ad.SHARES.values())


def test_metric_rows_survive_a_csv(spark, tmp_path):
    rows = [("s", "answers", "rouge1_precision", 0.5), ("s", "retrieval", "precision@5", 0.25), ("s", "answers", "greedy_f1", 1.0)]
    sinks.write_csv(ad.metric_rows(spark.createDataFrame(rows, "system string, category string, metric string, value double")), str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert {(r["category"], r["metric"], float(r["value"])) for r in back.collect()} == {
        ("answers", "rouge1.precision", 0.5), ("retrieval", "precision@5", 0.25), ("answers", "greedy.f1", 1.0)}
