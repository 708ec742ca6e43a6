"""Adversarial rewriting rules."""

from pyspark.sql import functions as F

from qamill.operators import adversarial as ad
from qamill.operators.gold import GOLD_TYPE

T = F.col("t")


def test_paraphrases(one):
    assert one(ad.paraphrases(T), t="What is the difference?") == [
        "Can you explain what the difference is?", "Which is the difference?", "What is the distinction?"]
    assert one(ad.paraphrases(T), t="What does it do?") == ["Which does it do?", "What is done by it?"]
    assert one(ad.paraphrases(T), t="Name it.") == ["Please tell me: Name it."]


def test_ambiguous(one):
    assert one(ad.ambiguous(T), t="Who won in the Big Race today?") == "Who won today?"
    assert one(ad.ambiguous(T), t="Who won in 2020?") == "Who won ?"
    assert one(ad.ambiguous(T), t="Who is named in this work?") == "Who is named ?"
    assert one(ad.ambiguous(T), t="Why so?") == "Why might so?"
    got = one(ad.ambiguous(T), t="Who ran to his house?").split()
    assert got[2] in ad.PRONOUNS and len(got) == 5
    assert one(ad.ambiguous(T), t="Who ran?") == "Who ran?"


def test_irrelevant(one):
    got = one(ad.irrelevant(T), t="What now?")
    assert any(got == p + "what now?" for p in ad.ASIDES)


def test_targeted_rules(one):
    assert one(ad.targeted_paraphrase(T), t="What is a net?") == "Could you explain what a net is?"
    assert one(ad.targeted_paraphrase(T), t="How does it go?") == "In what way does it go?"
    assert one(ad.targeted_paraphrase(T), t="Can you tell?") == "Would you be able to tell?"
    assert one(ad.targeted_paraphrase(T), t="Which?").split(" ", 0)[0].endswith("Which?")
    got = one(ad.targeted_ambiguous(T), t="Does the Stockmeyer idea hold today?").split()
    assert got[2] in ad.PRONOUNS
    assert one(ad.targeted_ambiguous(T), t="Is it good for deep nets?") == "Is it good?"
    assert one(ad.targeted_ambiguous(T), t="Is it?") is None


def test_impossible_matches_published_texts(one):
    got = one(ad.impossible(T), t="When was Stockmeyer first introduced?")
    assert any(got == p + "was Stockmeyer?" for p in ad.IMPOSSIBLE_PREFIXES)
    assert one(ad.impossible(T), t="Who developed Darwiche?") == "Who developed Darwiche according to unpublished data?"
    assert one(ad.impossible(T), t="What is it?") == "What will is it?"
    assert one(ad.impossible(T), t="Will this paper do?") == "Will this paper do that was deliberately excluded from the paper?"


def questions(spark):
    rows = [(f"q{i}", f"What is thing number {i}?", "factoid" if i % 2 else "causal", f"L{1 + i % 3}", ["impossible"] if i == 0 else [], i)
            for i in range(20)]
    df = spark.createDataFrame(rows, "question_id string, question string, query_type string, complexity string, special_categories array<string>, ix int")
    return df.withColumn("gold_answer", F.struct(
        F.lit("g").alias("text"), F.lit(False).alias("is_validated"),
        F.array().cast("array<struct<id:string,section:string,text:string>>").alias("supporting_passages")).cast(GOLD_TYPE))


def test_expand_ids_and_tags(spark):
    got = ad.expand(questions(spark)).where("adversarial.original_id = 'q0'").collect()
    ids = {r["question_id"]: r for r in got}
    assert {"q0_para_1", "q0_para_2", "q0_ambig", "q0_irrel"} == set(ids)
    assert ids["q0_ambig"]["special_categories"] == ["impossible", "ambiguous"]
    assert ids["q0_irrel"]["special_categories"] == ["impossible"]


def test_targeted_takes_the_first_of_weak_categories(spark):
    weak = spark.createDataFrame([("query_type", "causal"), ("complexity", "L1"), ("paper_id", "p")], "field string, value string")
    rows = ad.targeted(questions(spark), weak, "ix").collect()
    by = {}
    for r in rows:
        by.setdefault(r["adversarial"]["technique"], []).append(r["adversarial"]["original_id"])
    assert sorted(by["paraphrase"]) == sorted(by["irrelevant_context"]) == ["q0", "q2", "q4", "q6", "q8"]
    assert set(by["ambiguity"]) == {"q0", "q3", "q6", "q9", "q12"}
    assert set(by["impossible"]) == {"q0", "q1", "q2", "q3", "q4"}
    impossible = [r for r in rows if r["question_id"] == "q0_imp"][0]
    assert impossible["special_categories"] == ["impossible"] and impossible["gold_answer"]["text"] == ad.REFUSAL
    assert impossible["adversarial"]["original_text"] == "What is thing number 0?"
