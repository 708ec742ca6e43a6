"""Numbered slot fillings and the assignment of texts to papers."""

import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F
from test_questions import KIND, paper

from qamill.operators import assignment as asg
from qamill.operators import catalogue as cat
from qamill.operators import fillings as fl
from qamill.operators import questions as qu
from qamill.session import materialise

ONE = {"factoid": ["What is meant by {concept}?"]}


def papers(spark, concepts):
    return spark.createDataFrame([(p, "A Title", "About.", [("1. Introduction", "Text.")], [
        (c, "technical_term", 1, []) for c in cs]) for p, cs in concepts.items()], KIND)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_hash(*parts):
    return signed(xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode(), 42))


def plain_fill(values, t, number, paper_id, seed=42):
    """Digits, permutation and texts in plain Python; values are in their hashed order already."""
    slots = t["slots"]
    second = [any(s[:-1] == p and s[-1:] in "12" and f"{p}{3 - int(s[-1])}" in slots[:i] for p in fl.PAIRS) and len(values[s]) > 1
              for i, s in enumerate(slots)]
    radix = [len(values[s]) - x for s, x in zip(slots, second)]
    digits = []
    for n in radix:
        number, d = divmod(number, n)
        digits.append(d)
    for step in range(2 * len(slots)):
        at = step % len(slots)
        h = 42
        for part in (struct.pack("<i", seed), paper_id.encode(), struct.pack("<i", t["id"]), struct.pack("<i", step),
                     *[struct.pack("<q", -1 if j == at else d) for j, d in enumerate(digits)]):
            h = xxhash.xxh64_intdigest(part, h)
        digits[at] = (digits[at] + signed(h) % radix[at]) % radix[at]
    text, used = t["template"], {}
    for i, s in enumerate(slots):
        d = digits[i]
        if second[i]:
            other = slots.index(f"{s[:-1]}{3 - int(s[-1])}")
            d += d >= digits[other]
        used[s] = values[s][d]
    for s, v in used.items():
        text = text.replace("{" + s + "}", v)
    return text, used


def test_fillings_equal_plain_python(spark):
    parts = qu.components(paper(spark))
    values = qu.offers(parts).first()["slot_values"]
    known = {(t["query_type"], t["template_ix"]): t for t in fl.listed(cat.TEMPLATES)}
    rows = qu.instantiate(parts, variants=5).collect()
    for r in rows:
        assert (r["question"], r["template_slots"] or {}) == plain_fill(values, known[r["query_type"], r["template_ix"]], r["variant"], "p1")
    concepts = ["Graph Nets", "Trees", "message passing"]
    assert values["concept"] == sorted(concepts, key=lambda v: (plain_hash(42, "p1", v), v)) == values["concept1"]


def test_no_filling_comes_twice_and_the_count_is_known(spark):
    templates = {"comparative": ["How do {concept1} and {concept2} differ in {category} and {context}?", "Is {concept2} like {concept1}?"],
                 "factoid": ["What is {concept}?", "What is it all about?", "Who made {nothing}?"]}
    parts = qu.components(papers(spark, {"p": [f"net {i}" for i in range(6)]}))
    offer = qu.offers(parts, templates).first()
    assert offer["counts"] == [6 * 5 * 5 * 4, 30, 6, 1, 0] and offer["fillings"] == 637
    rows = qu.instantiate(parts, templates, variants=10**6).collect()
    texts = {(r["query_type"], r["template_ix"], r["question"]) for r in rows}
    assert len(rows) == len(texts) == 638  # the dead template shows its bracket once
    later = qu.instantiate(parts, templates, variants=10, first=5).collect()
    assert {r["variant"] for r in later} == {5, 6, 7, 8, 9} and {r["question"] for r in later} <= {r["question"] for r in rows}


def max_flow(wishes, n):
    """Texts that can be given out at most, by augmenting paths."""
    holder = {}

    def gain(p, seen):
        for t in wishes[p]:
            if t not in seen:
                seen.add(t)
                if t not in holder or gain(holder[t], seen):
                    holder[t] = p
                    return True
        return False

    return sum(gain(p, set()) for p in wishes for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_assignment_has_more_texts(spark, seed):
    rng = random.Random(seed)
    concepts = {f"p{i}": sorted(rng.sample([f"net {k}" for k in range(14)], rng.randrange(1, 8))) for i in range(9)}
    made = qu.generate(papers(spark, concepts), 3, ONE, exchanges=None).collect()
    assert len({r["question"] for r in made}) == len(made) == max_flow(concepts, 3)
    for p in concepts:
        mine = [r["template_slots"]["concept"] for r in made if r["paper_id"] == p]
        assert len(mine) <= 3 and set(mine) <= set(concepts[p])


def test_long_chains_of_exchanges(spark):
    """Each paper can take two neighbouring texts; the last free one is at the far end."""
    concepts = {f"p{i}": [f"net {i}", f"net {i + 1}"] for i in range(6)} | {"q": ["net 0"]}
    assert qu.generate(papers(spark, concepts), 1, ONE, exchanges=None).count() == 7
    fewer = qu.generate(papers(spark, concepts), 1, ONE, exchanges=0).count()
    assert 5 <= fewer <= 7


def test_scope_paper_gives_every_paper_its_own(spark):
    concepts = {f"p{i}": [f"net {k}" for k in range(12)] for i in range(4)}
    made = qu.generate(papers(spark, concepts), 12, ONE, scope="paper").collect()
    assert len(made) == 48 and len({(r["paper_id"], r["question"]) for r in made}) == 48
    chosen = qu.select_questions(qu.candidates(papers(spark, concepts), ONE, 12, scope="paper"), 12)
    assert chosen.count() == 48


def test_quota_of_types_is_kept_where_it_can_be(spark):
    rows = qu.generate(paper(spark), 20).collect()
    quota = spark.range(1).select(qu.quotas(F.lit(20)).alias("q")).first()["q"]
    assert len(rows) == 20
    assert {t: sum(r["query_type"] == t for r in rows) for t in quota} == quota


def test_shortage_and_empty_tables(spark):
    many = papers(spark, {"p": ["a net"], "q": ["a net", "b net", "c net"]})
    offers = materialise(qu.offers(qu.components(many), ONE), "offers")
    made = qu.generate(many, 3, ONE)
    rows = {r["paper_id"]: r.asDict() for r in asg.shortage(made, offers, 3).collect()}
    assert rows == {"p": {"paper_id": "p", "found": 1, "missing": 2, "fillings": 1, "cause": "used_up"},
                    "q": {"paper_id": "q", "found": 2, "missing": 1, "fillings": 3, "cause": "taken"}}
    assert qu.generate(many.limit(0), 3, ONE).count() == 0
    assert qu.generate(many, 3, {"factoid": ["What is {nothing}?"]}).count() == 0
