"""Question generation from papers and templates.

A paper is one row with ``paper_id, title, abstract, sections, concepts``. Templates
are instantiated inside the row; only finished questions leave it. Every random
choice is a hash of the seed and the row's own keys, so any rerun gives the same set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.functions.rows import unnest
from qamill.functions.picks import draw, uniform, weighted
from qamill.operators import assignment as asg
from qamill.operators import catalogue as cat
from qamill.operators import fillings as fl
from qamill.session import materialise

STRINGS = "array<string>"
#: Rounds of exchange after which ``generate`` leaves it at what is assigned; None goes on to the maximum.
EXCHANGES = 2


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(STRINGS)


def components(papers: DataFrame) -> DataFrame:
    """Q1–Q6, Q11: what a paper offers for slots, as de-duplicated arrays."""
    sent = lambda s: tx.sentences(s["content"])
    head = lambda s: F.lower(s["heading"])
    is_method = lambda s: head(s).rlike(cat.METHOD_HEADINGS)
    is_result = lambda s: ~is_method(s) & head(s).rlike(cat.RESULT_HEADINGS)
    gather = lambda rows, f: F.flatten(F.transform(rows, f))
    method_rows = F.filter("sections", is_method)
    result_rows = F.filter("sections", is_result)
    found = {
        "concept_texts": F.array_distinct(F.transform("concepts", lambda c: c["text"])),
        "entities": F.array_distinct(F.transform(
            F.filter("concepts", lambda c: c["type"] == "entity"), lambda c: c["text"])),
        "methods": F.array_distinct(gather(method_rows, lambda s: F.regexp_extract_all(
            s["content"], F.lit(cat.METHOD_PHRASE), F.lit(0)))),
        "processes": F.array_distinct(gather(method_rows, lambda s: F.filter(
            sent(s), lambda x: F.lower(x).rlike(cat.PROCESS_CUES)))),
        "results": gather(result_rows, lambda s: F.filter(sent(s), lambda x: F.lower(x).rlike(cat.RESULT_CUES))),
        "metrics": F.array_distinct(F.filter(gather(result_rows, lambda s: F.transform(
            sent(s), lambda x: F.regexp_extract(x, cat.METRIC_NAMES, 1))), lambda x: x != "")),
        "key_sentences": F.array_distinct(gather(F.col("sections"), lambda s: F.filter(
            sent(s), lambda x: x.rlike(cat.KEY_CUES)))),
        "has_experiment": F.exists("sections", lambda s: head(s) == "experiment"),
        "domain": infer_domain(),
    }
    return papers.withColumns(found)


def section_map(sections: Column) -> Column:
    """Q1: lowered heading to content, the last section of a heading wins."""
    last = F.filter(sections, lambda s, i: F.array_position(
        F.slice(F.transform(sections, lambda x: F.lower(x["heading"])), i + 2, F.size(sections)),
        F.lower(s["heading"])) == 0)
    return F.map_from_entries(F.transform(last, lambda s: F.struct(F.lower(s["heading"]), s["content"])))


def infer_domain() -> Column:
    """Q11: first listed domain in title and abstract, else in the introduction, else in
    the five most frequent concepts; empty when none."""
    domains = _strings(cat.DOMAINS)
    first_in = lambda text: F.get(F.filter(domains, lambda d: F.contains(text, d)), F.lit(0))
    front = F.lower(F.concat_ws(" ", "title", "abstract"))
    intro = F.filter("sections", lambda s: F.lower(s["heading"]).rlike("introduction|background"))
    in_intro = F.get(F.filter(F.transform(intro, lambda s: first_in(F.lower(s["content"]))),
                              lambda d: d.isNotNull()), F.lit(0))
    top = F.slice(F.sort_array(F.transform("concepts", lambda c, i: F.struct(
        (-c["count"]).alias("n"), i.alias("ix"), F.lower(c["text"]).alias("text")))), 1, 5)
    in_top = F.get(F.filter(F.transform(top, lambda c: first_in(c["text"])), lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(tx.bind(front, first_in), in_intro, in_top, F.lit(""))


def _by_forms(sentence: Column, forms: list[str], group: int, default: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(sentence, f, group)), F.lit("")) for f in forms], default)


def process_phrase(sentence: Column) -> Column:
    """Q10."""
    return _by_forms(sentence, cat.PROCESS_FORMS, 1, F.lit("the described process"))


def finding_phrase(sentence: Column) -> Column:
    """Q10: the sentence itself when no form fits."""
    return _by_forms(sentence, cat.FINDING_FORMS, 1, sentence)


def improvement_phrase(sentence: Column) -> Column:
    """Q10."""
    return _by_forms(sentence, cat.IMPROVEMENT_FORMS, 0, F.lit("improvement"))


def quotas(total: Column, shares: dict[str, float] = cat.TYPE_SHARES) -> Column:
    """Q7: questions per type as a map.

    Half-even rounding of total·share, then one pass: missing ones go to types in
    alphabetical order, surplus comes off the largest (first listed on ties).
    """
    names = list(shares)
    base = {t: F.bround(total * F.lit(shares[t])).cast("int") for t in names}
    rest = total - sum((base[t] for t in names), F.lit(0))
    alphabetical = {t: i + 1 for i, t in enumerate(sorted(names))}
    out = []
    for i, t in enumerate(names):
        larger = sum((F.when((base[u] > base[t]) | ((base[u] == base[t]) & F.lit(j < i)), 1).otherwise(0)
                      for j, u in enumerate(names) if u != t), F.lit(0))
        fix = F.when((rest > 0) & (F.lit(alphabetical[t]) <= rest), 1).when(
            (rest < 0) & (larger < -rest), -1).otherwise(0)
        out += [F.lit(t), (base[t] + fix).cast("int")]
    return F.create_map(*out)


def template_slots(template: Column) -> Column:
    """Q8."""
    return F.regexp_extract_all(template, F.lit(r"\{([^}]+)\}"), F.lit(1))


PHRASES = {"process": process_phrase, "finding": finding_phrase, "improvement": improvement_phrase}


def offers(parts: DataFrame, templates: dict[str, list[str]] | None = None, seed: int = 42) -> DataFrame:
    """What each paper can be asked, with the number of fillings of every template, see ``fillings``.

    ``parts`` comes from ``components``.
    """
    return fl.offers(parts, templates or cat.TEMPLATES, PHRASES, seed)


def instantiate(papers: DataFrame, templates: dict[str, list[str]] | None = None, variants: int = 2,
                seed: int = 42, first: int = 0) -> DataFrame:
    """Q9: the fillings from ``first`` up to ``variants`` of every template, as many as there are.

    ``papers`` comes from ``components``. No filling of a template comes twice, whatever the range. A
    template with a slot that has no value keeps the slot's name in brackets.
    """
    templates = templates or cat.TEMPLATES
    numbered = lambda t: F.get("counts", t["id"])
    rows = offers(papers, templates, seed)
    each = F.flatten(F.transform(fl.constant(templates), lambda t: F.when(
        F.greatest(numbered(t), F.lit(1)) > first, F.transform(
            F.sequence(F.lit(first).cast("long"), F.least(F.greatest(numbered(t), F.lit(1)), F.lit(variants)) - 1),
            lambda v: F.struct(t["id"].alias("id"), v.alias("v")))).otherwise(F.array().cast("array<struct<id:int,v:bigint>>"))))
    filled = tx.bind(fl.shaped(templates), lambda shapes: F.transform(
        each, lambda x: fl.fill(F.get(shapes, x["id"]), x["v"], seed)))
    out = unnest(rows, filled, ["paper_id"]).select("paper_id", "item.*")
    return out.withColumn("pick", draw(seed, F.col("paper_id"), F.col("query_type"), F.col("template_ix"), F.col("variant")))


def is_valid(question: Column) -> Column:
    """Q12, less the duplicate rule."""
    return (~question.rlike(r"\[[\p{L}\p{N}_]+\]")) & (F.length(question) >= 10) & question.endswith("?")


def _same(scope: str) -> list[str]:
    """What two duplicates share: the text in a ``set``, paper and text in a ``paper``."""
    return {"set": ["question"], "paper": ["paper_id", "question"]}[scope]


def distinct_questions(candidates: DataFrame, scope: str = "set") -> DataFrame:
    """Q12: one row per question text over all papers (or per paper), the one with the lowest pick.

    A text that every paper yields is reduced inside each task before the shuffle.
    """
    keys = _same(scope)
    rest = [c for c in candidates.columns if c not in ("question", "pick", *keys)]
    best = F.min_by(F.struct(*rest, "pick"), F.struct("pick", "paper_id")).alias("b")
    return candidates.groupBy(*keys).agg(best).select(*keys, "b.*")


def complexity(question: Column, query_type: Column, seed: int = 42) -> Column:
    """Q13."""
    u = uniform(seed, "complexity", question)
    out = None
    for types, weights in cat.LEVEL_WEIGHTS.items():
        level = weighted(weights, u)
        if types is None:
            return out.otherwise(level)
        out = F.when(query_type.isin(list(types)), level) if out is None else out.when(query_type.isin(list(types)), level)
    return out


def special_categories(question: Column, seed: int = 42) -> Column:
    """Q14: substring rules; ambiguous and impossible with their chances."""
    low = F.lower(question)
    many = lambda w: tx.count_plain(low, F.lit(w)) > 1
    any_of = lambda words: low.rlike("|".join(words))
    return F.array_compact(F.array(
        F.when(F.contains(question, F.lit("and")) & (many("what") | many("how")), "multi_part"),
        F.when(any_of(cat.TEMPORAL_WORDS), "temporal"),
        F.when(any_of(cat.AMBIGUOUS_WORDS) & (uniform(seed, "ambiguous", question) < cat.AMBIGUOUS_CHANCE), "ambiguous"),
        F.when(uniform(seed, "impossible", question) < cat.IMPOSSIBLE_CHANCE, "impossible"),
    ))


def question_id(question: Column) -> Column:
    """Q15."""
    return F.concat(F.lit("q_"), F.substring(F.md5(question), 1, 12))


def answer_text(categories: Column) -> Column:
    """Q23."""
    return F.when(F.array_contains(categories, "impossible"), cat.NOT_POSSIBLE).otherwise(cat.PLACEHOLDER)


def annotate(questions: DataFrame, seed: int = 42) -> DataFrame:
    """Q13–Q15, Q23 on question rows."""
    out = questions.withColumns({
        "question_id": question_id(F.col("question")),
        "complexity": complexity(F.col("question"), F.col("query_type"), seed),
        "special_categories": special_categories(F.col("question"), seed),
    })
    return out.withColumn("answer", answer_text(F.col("special_categories")))


def select_questions(candidates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Q16: ``n`` questions per paper: the quota of each type, then a weighted refill.

    Leftover candidates compete by -ln(u)/weight, which is a draw without replacement
    by the target shares. Every window is cut to a fixed rank inside the tasks before
    rows meet, so a paper with very many candidates sends only a few times ``n`` rows:
    no type fills more than ``n``, and among the best 2n of the race at least n are not
    taken by a quota.
    """
    quota = quotas(F.lit(n))
    weight = F.create_map(*[x for t, s in cat.TYPE_SHARES.items() for x in (F.lit(t), F.lit(s))])
    u = F.greatest(uniform(seed, "refill", F.col("paper_id"), F.col("question")), F.lit(1e-12))
    race = -F.ln(u) / F.coalesce(F.try_element_at(weight, F.col("query_type")), F.lit(0.01))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by[0]).orderBy(*by[1]))

    in_type = rank(["paper_id", "query_type"], ["pick", "question"])
    chosen = candidates.withColumn("_rank", in_type).where(F.col("_rank") <= n).where(
        F.col("_rank") <= F.coalesce(F.try_element_at(quota, F.col("query_type")), F.lit(0)))
    pool = candidates.withColumn("_race", race).withColumn(
        "_rank", rank(["paper_id"], ["_race", "question"])).where(F.col("_rank") <= 2 * n)
    rest = pool.join(chosen.select("paper_id", "question"), ["paper_id", "question"], "left_anti").withColumn("_turn", F.lit(1))
    both = chosen.withColumns({"_race": F.lit(0.0), "_turn": F.lit(0)}).drop("_rank").unionByName(rest.drop("_rank"))
    final = rank(["paper_id"], ["_turn", "_race", "question"])
    return both.withColumn("_rank", final).where(F.col("_rank") <= n).drop("_rank", "_race", "_turn")


def seed_questions(candidates: DataFrame, per_type: int = 3) -> DataFrame:
    """Q17: the first ``per_type`` of each type, marked for review."""
    w = W.partitionBy("paper_id", "query_type").orderBy("pick", "question")
    return candidates.withColumn("_rank", F.row_number().over(w)).where(
        F.col("_rank") <= per_type).drop("_rank").withColumn("is_seed", F.lit(True))


def candidates(papers: DataFrame, templates: dict[str, list[str]] | None = None, variants: int = 2,
               seed: int = 42, first: int = 0, scope: str = "set") -> DataFrame:
    """Valid, distinct candidates of all papers (``papers`` with sections and concepts)."""
    filled = instantiate(components(papers), templates, variants, seed, first)
    return distinct_questions(filled.where(is_valid(F.col("question"))), scope)


def shortfall(questions: DataFrame, papers: DataFrame, n: int, own: DataFrame | None = None) -> DataFrame:
    """(paper_id, found, missing) of the papers with fewer than ``n`` questions.

    With ``own`` (paper_id, question: the texts each paper yields by itself, ``candidates`` of scope
    paper) also the cause: ``used_up`` if these are fewer than ``n``, else ``taken`` by other papers.
    """
    counts = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce("found", F.lit(0)).cast("long")
    short = papers.select("paper_id").join(counts, "paper_id", "left").where(found < n).select(
        "paper_id", found.alias("found"), (F.lit(n) - found).alias("missing"))
    if own is None:
        return short
    texts = own.select("paper_id", "question").distinct().groupBy("paper_id").agg(F.count(F.lit(1)).alias("_own"))
    enough = F.coalesce("_own", F.lit(0)) >= n
    return short.join(texts, "paper_id", "left").withColumn(
        "cause", F.when(enough, "taken").otherwise("used_up")).drop("_own")


def generate(papers: DataFrame, n: int = 20, templates: dict[str, list[str]] | None = None,
             seed: int = 42, store=materialise, scope: str = "set", exchanges: int | None = EXCHANGES,
             taken: DataFrame | None = None) -> DataFrame:
    """Q16 with contexts: the question table of a set of papers.

    Every paper gets ``n`` questions if texts last, see ``assignment.assign``; with ``exchanges`` None no
    other assignment gives out more, with the default a few texts may stay unasked where papers
    share most of theirs. ``assignment.shortage`` lists the papers with fewer and the cause. What the
    papers offer is written once by ``store``, without their texts, and so are the questions before
    their contexts, which need them several times. ``taken`` holds questions of earlier runs, which are
    not asked again.
    """
    templates = templates or cat.TEMPLATES
    made = store(offers(components(papers), templates, seed), "offers")
    chosen = asg.assign(made, n, templates, quotas(F.lit(n)), is_valid, seed, store, scope, exchanges, taken)
    return with_contexts(store(annotate(chosen, seed), "chosen"), papers)


# Contexts -----------------------------------------------------------------------------


def around(text: Column, term: Column, width: int = 200, low: Column | None = None) -> Column:
    """Q18: ``width`` characters on both sides of the first mention, grown to sentence ends.

    ``low`` is the text in lower case, where it is known already."""
    exact = F.position(term, text)
    at = F.when(exact > 0, exact).otherwise(F.position(F.lower(term), F.lower(text) if low is None else low)) - 1

    def cut(low: Column, high: Column) -> Column:
        lead = F.length(F.regexp_replace(F.substring(text, F.lit(1), low + 1), r"[^.!?]*\z", ""))
        start = F.when(lead > 1, lead).otherwise(0)
        more = F.length(F.regexp_extract(F.substring(text, high + 1, F.length(text)), r"^[^.!?]*", 0))
        end = F.least(high + more + 1, F.length(text))
        return tx.strip(F.substring(text, start + 1, end - start))

    low = F.greatest(at - width, F.lit(0))
    high = F.least(at + F.length(term) + width, F.length(text))
    return F.when(at < 0, "").otherwise(cut(low, high))


def shorten(text: Column, limit: int = 500) -> Column:
    """Q22: whole sentences from the front while they fit ``limit``."""
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))
    fitted = F.aggregate(
        tx.sentences(text), start,
        lambda a, s: F.when(
            a["open"] & (F.length(a["out"]) + F.length(s) <= limit),
            F.struct(F.concat(a["out"], s, F.lit(" ")).alias("out"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["out"].alias("out"), F.lit(False).alias("open"))),
        lambda a: tx.strip(a["out"]),
    )
    return F.when(F.length(text) <= limit, text).otherwise(fitted)


def _low(s: Column) -> Column:
    return F.lower(s["content"])


def definition(term: Column, sections: Column, lowered=_low) -> Column:
    """Q19: the sentence of the first definition pattern, section by section; else the
    first sentence near the first mention; null when the term is absent."""
    low = F.lower(term)
    mentions = F.filter(sections, lambda s: F.contains(lowered(s), low))
    form = lambda p: F.concat(*[x for i, part in enumerate(p.split("%s")) for x in (
        [tx.quoted(term)] if i else []) + [F.lit(part)]])
    tried = F.flatten(F.transform(mentions, lambda s: F.array(*[
        F.struct(F.call_function("regexp_extract", s["content"], form(p), F.lit(0)).alias("hit"),
                 s["content"].alias("content")) for p in cat.DEFINITION_FORMS])))
    first = F.get(F.filter(tried, lambda t: t["hit"] != ""), F.lit(0))
    by_form = tx.bind(first, lambda f: F.when(f.isNotNull(), F.coalesce(
        F.get(F.filter(tx.sentences(f["content"]), lambda x: F.contains(x, f["hit"])), F.lit(0)), f["hit"])))

    def near(s: Column) -> Column:
        at = F.position(low, lowered(s)) - 1
        begin = F.greatest(at - 100, F.lit(0))
        window = F.substring(s["content"], begin + 1, at + 200 - begin)
        return F.get(F.filter(tx.sentences(window), lambda x: F.contains(F.lower(x), low)), F.lit(0))

    nearby = F.get(F.filter(F.transform(mentions, near), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(by_form, nearby)


def comparison(term1: Column, term2: Column, sections: Column, lowered=_low) -> Column:
    """Q20: from the first section with both terms: a sentence with both, else two
    adjacent ones, else the paragraph, else both contexts."""
    a, b = F.lower(term1), F.lower(term2)
    has = lambda x, t: F.contains(F.lower(x), t)
    both_in = lambda s: F.contains(lowered(s), a) & F.contains(lowered(s), b)
    section = F.get(F.filter(sections, both_in), F.lit(0))["content"]

    def tiers(text: Column) -> Column:
        def by_sentence(sent: Column) -> Column:
            both = F.get(F.filter(sent, lambda x: has(x, a) & has(x, b)), F.lit(0))
            pairs = F.transform(sent, lambda x, i: F.struct(x.alias("x"), F.get(sent, i + 1).alias("y")))
            next_to = F.get(F.filter(pairs, lambda p: (has(p["x"], a) & has(p["y"], b)) | (
                has(p["x"], b) & has(p["y"], a))), F.lit(0))
            return F.coalesce(both, F.concat_ws(" ", F.nullif(next_to["x"], F.lit("")), next_to["y"]))

        i1, i2 = F.position(a, F.lower(text)) - 1, F.position(b, F.lower(text)) - 1
        low = F.least(i1, i2)
        high = F.greatest(i1 + F.length(term1), i2 + F.length(term2))
        start = F.length(F.regexp_replace(F.substring(text, F.lit(1), low), r"[^\n]*\z", ""))
        more = F.length(F.regexp_extract(F.substring(text, high + 1, F.length(text)), r"^[^\n]*", 0))
        paragraph = F.substring(text, start + 1, high + more - start)
        far = F.concat(around(text, term1, 100), F.lit(" [...] "), around(text, term2, 100))
        rest = F.when(F.length(paragraph) <= 500, tx.strip(paragraph)).otherwise(far)
        return F.coalesce(F.nullif(tx.bind(tx.sentences(text), by_sentence), F.lit("")), rest)

    return F.when((a != "") & (b != "") & section.isNotNull(), tx.bind(section, tiers))


#: Questions of a paper that are worked on in one row.
TOGETHER = 256


def with_contexts(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Q18–Q21: adds ``contexts``.

    Needs ``query_type`` and ``template_slots``; papers need ``abstract`` and ``sections``. The
    questions of a paper meet it in one row (or one per TOGETHER of them), so a paper's text is moved,
    lowered and read for its fallback context once, however many questions it has.
    """
    none = F.array().cast("array<struct<section:string,text:string>>")
    item = lambda section, text: F.struct(section.alias("section"), text.alias("text"))
    sections, low = F.col("_sections"), lambda s: s["low"]

    def mention(value: Column) -> Column:
        s = F.get(F.filter(sections, lambda x: F.contains(x["content"], value)), F.lit(0))
        return tx.bind(s, lambda x: F.when(x.isNotNull(), item(x["heading"], around(x["content"], value, low=x["low"]))))

    def contexts(q: Column) -> Column:
        slots, kind = q["template_slots"], q["query_type"]
        slot = lambda k: F.try_element_at(slots, F.lit(k))
        factoid = F.filter(F.transform(F.map_values(slots), mention), lambda x: x.isNotNull())
        terms = F.array_compact(F.array(slot("concept"), slot("term")))
        defined = F.filter(F.transform(terms, lambda t: tx.bind(
            definition(t, sections, low), lambda d: F.when(d.isNotNull(), item(F.lit("Definition"), d)))),
            lambda x: x.isNotNull())
        first, second = F.coalesce(slot("concept1"), slot("method1")), F.coalesce(slot("concept2"), slot("method2"))
        compared = tx.bind(comparison(first, second, sections, low), lambda c: F.when(
            c.isNotNull(), F.array(item(F.lit("Comparison"), c))).otherwise(none))
        specific = F.coalesce(F.when(kind == "factoid", factoid).when(kind == "definitional", defined).when(
            kind == "comparative", compared), none)
        return tx.bind(specific, lambda s: F.when(F.size(s) > 0, s).otherwise(
            F.coalesce(F.try_element_at("_generic", kind), F.col("_abstract"))))

    counts = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(*[c for c, t in questions.dtypes if not t.startswith("map")]), F.ceil(F.col("_n") / TOGETHER))
    rest = [c for c in questions.columns if c != "paper_id"]
    lists = questions.join(counts, "paper_id").groupBy("paper_id", part.alias("_part")).agg(
        F.collect_list(F.struct(*rest)).alias("_questions"))
    front = F.array_compact(F.array(F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", item(F.lit("Abstract"), F.col("abstract")))))
    fallback = []
    for types, words in cat.CONTEXT_HEADINGS.items():
        hit = F.get(F.filter("sections", _heading_has(words)), F.lit(0))
        found = tx.bind(hit, lambda r: F.array_compact(F.array(F.when(r["heading"].isNotNull(), item(r["heading"], shorten(r["content"]))))))
        fallback += [(t, F.concat(F.col("_abstract"), found)) for t in types]
    texts = papers.select("paper_id", "sections", front.alias("_abstract"), F.transform("sections", lambda s: F.struct(
        s["heading"].alias("heading"), s["content"].alias("content"), F.lower(s["content"]).alias("low"))).alias("_sections"))
    asked = lists.select("paper_id").distinct()
    texts = texts.join(asked, "paper_id", "left_semi").withColumn("_generic", F.create_map(*[x for t, c in fallback for x in (F.lit(t), c)]))
    filled = F.transform("_questions", lambda q: F.struct(q.alias("q"), contexts(q).alias("contexts")))
    out = unnest(lists.join(texts.drop("sections"), "paper_id"), filled, ["paper_id"])
    return out.select("paper_id", "item.q.*", "item.contexts").select(*questions.columns, "contexts")


def _heading_has(words: list[str]):
    return lambda s: F.lower(s["heading"]).rlike("|".join(words))


def distribution_gap(questions: DataFrame) -> DataFrame:
    """Q24: observed share against target share of every taxonomy value."""
    dims = {"query_type": cat.TYPE_SHARES, "complexity": cat.LEVEL_SHARES, "special_category": cat.SPECIAL_SHARES}
    targets = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.lit(s).alias("target"))
        for d, shares in dims.items() for v, s in shares.items()])
    values = F.concat(
        F.array(F.struct(F.lit("query_type").alias("dimension"), F.col("query_type").alias("value")),
                F.struct(F.lit("complexity").alias("dimension"), F.col("complexity").alias("value"))),
        F.transform("special_categories", lambda c: F.struct(
            F.lit("special_category").alias("dimension"), c.alias("value"))))
    counts = questions.select(F.inline(values)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    total = questions.agg(F.count(F.lit(1)).alias("total"))
    plan = total.select("total", F.inline(targets))
    observed = F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).otherwise(0.0)
    return plan.join(counts, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), observed.alias("observed"), "target",
        (observed - F.col("target")).alias("gap"))
