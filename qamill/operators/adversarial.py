"""Adversarial question variants. All rules are column expressions, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.functions.rows import unnest
from qamill.functions.picks import draw
from qamill.operators.gold import GOLD_TYPE

# Substitutions, prefixes, pronouns and patterns.
SUBSTITUTIONS = [
    ("What", "Which"), ("How", "In what way"), ("Why", "For what reason"), ("When", "At what time"),
    ("Where", "In which location"), ("important", "significant"), ("difference", "distinction"),
    ("similar", "comparable"), ("explain", "describe"), ("advantage", "benefit"),
    ("disadvantage", "drawback"),
]
PRONOUNS = ["it", "this", "that", "these", "those"]
SPECIFIC = [
    r"(in|of|for) the ([A-Z][a-z]+ ?)+", r"(in|of|for) ([0-9]{4})", r"(in|of|for) this [a-z]+",
]
MODIFIERS = [("What", "What potential"), ("How", "How might"), ("Why", "Why might")]
ASIDES = [
    "While thinking about something else, ", "I was reading another paper and wondered, ",
    "Although it might not be directly addressed, ", "In addition to other topics in the paper, ",
    "Besides the main contributions, ", "Considering the broader implications, ",
    "Without specific evidence, ", "In a tangentially related domain, ",
]
TARGETED_PREFIXES = [  # prefix, characters dropped, lead-in, ending
    ("What is", 8, "Could you explain what ", " is?"), ("How", 4, "In what way ", "?"),
    ("Why", 4, "For what reason ", "?"), ("Where", 6, "In which location ", "?"),
    ("When", 5, "At what time ", "?"), ("Can you", 8, "Would you be able to ", "?"),
]
LEAD_INS = [
    "I'm wondering:", "I'd like to know:", "Can you tell me:", "I'm interested in learning:",
    "Please explain:",
]
TARGETED_CONTEXT = [
    r" in the [A-Za-z]+ of [A-Za-z]+", r" for [A-Za-z]+ [A-Za-z]+", r" from [A-Za-z]+ \d+",
    r" according to [A-Za-z]+",
]
TARGETED_ASIDES = [
    "While thinking about a completely different topic, ",
    "Although it may not be directly addressed in the paper, ",
    "Without specific evidence in the text, ", "Setting aside the main focus of the paper, ",
    "As a hypothetical exploration not covered in the paper, ",
    "Though tangential to the main research, ", "From a different perspective than what's presented, ",
    "If we assume information not present in the document, ",
]
IMPOSSIBLE_PREFIXES = [
    "What classified information about ", "What unreported aspects of ",
    "What will be the future impact of ", "What undocumented features of ",
    "What proprietary details of ",
]
REFUSAL = "This question cannot be answered based on the information provided in the paper."


def _pick(options: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (draw(key) % len(options) + 1).cast("int"))


def _stem(question: Column, drop: int) -> Column:
    """The question past its first ``drop`` characters, without final question marks."""
    return F.regexp_replace(F.substring(question, F.lit(drop + 1), F.length(question)), r"\?+\z", "")


def _without(question: Column, patterns: list[str]) -> Column:
    """The question without the first match of the first pattern that occurs; else null."""
    out = None
    for p in patterns:
        gone = F.replace(question, F.regexp_extract(question, p, 0), F.lit(""))
        out = F.when(question.rlike(p), gone) if out is None else out.when(question.rlike(p), gone)
    return out


def _modified(question: Column) -> Column:
    out = None
    for word, longer in MODIFIERS:
        hit, new = question.startswith(word), F.replace(question, F.lit(word), F.lit(longer))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out


# The texts of paraphrases and of questions out of scope.
EXPLAIN = ("Can you explain what ", " is?")
DOES = r"What does ([^?]+) do\?"
DONE_BY = "What is done by "
PLEASE = "Please tell me: "
OUT_OF_SCOPE = (" that was deliberately excluded from the paper?", " according to unpublished data?")


def _aside(question: Column, asides: list[str]) -> Column:
    return F.concat(_pick(asides, question), F.lower(F.substring(question, 1, 1)),
                    F.substring(question, F.lit(2), F.length(question)))


def paraphrases(question: Column) -> Column:
    """A2: distinct rewrites in rule order, never the question itself."""
    subject = F.regexp_extract(question, DOES, 1)
    made = F.array_compact(F.array(
        F.when(question.startswith("What is"), F.concat(
            F.lit(EXPLAIN[0]), _stem(question, 8), F.lit(EXPLAIN[1]))),
        *[F.when(F.contains(question, F.lit(a)), F.replace(question, F.lit(a), F.lit(b))) for a, b in SUBSTITUTIONS],
        F.when(subject != "", F.concat(F.lit(DONE_BY), subject, F.lit("?"))),
    ))
    none = F.array(F.concat(F.lit(PLEASE), question))
    return F.filter(F.array_distinct(F.when(F.size(made) > 0, made).otherwise(none)), lambda p: p != question)


def ambiguous(question: Column) -> Column:
    """A3: drop a specific reference, else add a modifier, else a pronoun in the middle."""

    def in_middle(w: Column) -> Column:
        mid = F.floor(F.size(w) / 2).cast("int")
        return F.when(F.size(w) > 4, F.array_join(
            F.transform(w, lambda x, i: F.when(i == mid, _pick(PRONOUNS, question)).otherwise(x)), " "))

    return F.coalesce(_without(question, SPECIFIC), _modified(question), tx.bind(tx.words(question), in_middle), question)


def irrelevant(question: Column) -> Column:
    """A4."""
    return _aside(question, ASIDES)


def targeted_paraphrase(question: Column) -> Column:
    """By the first fitting prefix, else a lead-in."""
    out = None
    for prefix, drop, lead, end in TARGETED_PREFIXES:
        new = F.concat(F.lit(lead), _stem(question, drop), F.lit(end))
        hit = question.startswith(prefix)
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(F.concat_ws(" ", _pick(LEAD_INS, question), question))


def targeted_ambiguous(question: Column) -> Column:
    """A capitalised inner word to a pronoun, else drop a clause, else a modifier."""

    def pronoun(w: Column) -> Column:
        fits = F.transform(w, lambda x, i: (i >= 2) & (i < F.size(w) - 2) & x.rlike(r"^\p{Lu}") & (F.length(x) > 3))
        at = F.array_position(fits, F.lit(True))
        return F.when((F.size(w) > 4) & (at > 0), F.array_join(F.transform(
            w, lambda x, i: F.when(i == at - 1, _pick(PRONOUNS, x)).otherwise(x)), " "))

    return F.coalesce(tx.bind(tx.words(question), pronoun), _without(question, TARGETED_CONTEXT), _modified(question))


def targeted_irrelevant(question: Column) -> Column:
    """A9."""
    return _aside(question, TARGETED_ASIDES)


def impossible(question: Column) -> Column:
    """A10: a question about the future, else one outside the scope of the paper."""
    timeless = ~F.contains(F.lower(question), F.lit("in the future")) & ~F.contains(F.lower(question), F.lit("will"))
    w = tx.words(question)
    about = F.when(F.size(w) > 3, F.concat(
        _pick(IMPOSSIBLE_PREFIXES, question), F.array_join(F.slice(w, 2, 2), " "), F.lit("?")))
    future = F.when(timeless, F.when(question.startswith("What"), F.replace(question, F.lit("What"), F.lit("What will")))
                    .when(question.startswith("How"), F.replace(question, F.lit("How"), F.lit("How will")))
                    .otherwise(about))
    mark = lambda clause: F.replace(question, F.lit("?"), F.lit(clause))
    scope = F.when(question.rlike("paper|study|research"), mark(OUT_OF_SCOPE[0])
                   ).otherwise(mark(OUT_OF_SCOPE[1]))
    return F.coalesce(future, scope)


TECHNIQUES = ("paraphrase", "ambiguity", "irrelevant_context")
CATEGORY_OF = {"ambiguity": "ambiguous", "impossible": "impossible"}
SUFFIX_OF = {"paraphrase": "para", "ambiguity": "ambig", "irrelevant_context": "irrel", "impossible": "imp"}


def _variants(question: Column, techniques: tuple[str, ...]) -> Column:
    """All variants of a question as one array, so that questions are read once."""
    kind = "array<struct<technique:string,text:string,variant:int>>"
    one = lambda name, text: F.array(F.struct(
        F.lit(name).alias("technique"), text.alias("text"), F.lit(None).cast("int").alias("variant"))).cast(kind)
    parts = {
        "paraphrase": F.transform(paraphrases(question), lambda p, i: F.struct(
            F.lit("paraphrase").alias("technique"), p.alias("text"), (i + 1).cast("int").alias("variant"))).cast(kind),
        "ambiguity": one("ambiguity", ambiguous(question)),
        "irrelevant_context": one("irrelevant_context", irrelevant(question)),
    }
    return F.concat(*[parts[t] for t in techniques])


def expand(questions: DataFrame, techniques: tuple[str, ...] = TECHNIQUES) -> DataFrame:
    """A1: every question times every technique, with new ids and metadata.

    Needs ``question_id, question, special_categories``; other columns are kept.
    """
    rest = [c for c in questions.columns if c not in ("question_id", "question", "special_categories")]
    rows = unnest(questions, _variants(F.col("question"), techniques), ["*"], item="v").where(
        (F.col("v.text") != "") & (F.col("v.text") != F.col("question")))
    return rows.select(
        *rest, _suffixed(F.col("v.technique"), F.col("v.variant")).alias("question_id"),
        F.col("v.text").alias("question"), _categories(F.col("v.technique")).alias("special_categories"),
        F.struct(F.col("v.technique").alias("technique"), F.col("question_id").alias("original_id"),
                 F.lit(None).cast("string").alias("original_text"), F.col("v.variant").alias("variant")).alias("adversarial"))


def _suffixed(technique: Column, variant: Column) -> Column:
    names = F.create_map(*[x for k, v in SUFFIX_OF.items() for x in (F.lit(k), F.lit(v))])
    return F.concat_ws("_", "question_id", F.element_at(names, technique), variant.cast("string"))


def _categories(technique: Column) -> Column:
    had = F.coalesce("special_categories", F.array().cast("array<string>"))
    extra = F.when(technique == "ambiguity", F.array(F.lit("ambiguous"))).when(
        technique == "impossible", F.array(F.lit("impossible"))).otherwise(F.array().cast("array<string>"))
    return F.array_union(had, extra)


def vulnerable(flags: DataFrame) -> DataFrame:
    """A5: the worst category of every flagged field."""
    return flags.select("field", F.col("worst").alias("value")).distinct()


def _apply(questions: DataFrame, technique: str, text: Column) -> DataFrame:
    rest = [c for c in questions.columns if c not in ("question_id", "question", "special_categories", "gold_answer")]
    gold = []
    if "gold_answer" in questions.columns:
        refusal = F.struct(
            F.lit(REFUSAL).alias("text"), F.lit(True).alias("is_validated"),
            F.array().cast("array<struct<id:string,section:string,text:string>>").alias("supporting_passages")).cast(GOLD_TYPE)
        had = F.col("gold_answer")
        gold = [(F.when(had.isNotNull(), refusal) if technique == "impossible" else had).alias("gold_answer")]
    rows = questions.withColumn("_new", text).where((F.col("_new") != "") & (F.col("_new") != F.col("question")))
    name = F.lit(technique)
    return rows.select(
        *rest, *gold, _suffixed(name, F.lit(None)).alias("question_id"), F.col("_new").alias("question"),
        _categories(name).alias("special_categories"),
        F.struct(name.alias("technique"), F.col("question_id").alias("original_id"),
                 F.col("question").alias("original_text"), F.lit(None).cast("int").alias("variant")).alias("adversarial"))


def first_of_category(questions: DataFrame, weak: DataFrame, field: str, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` questions of every vulnerable value of ``field``.

    ``weak`` holds at most one row per taxonomy value; the rank limit applies in every
    task before rows meet.
    """
    values = weak.where(F.col("field") == field).select(F.col("value").alias(field))
    rank = F.row_number().over(W.partitionBy(field).orderBy(order))
    return questions.join(values, field, "left_semi").withColumn("_rank", rank).where(
        F.col("_rank") <= k).drop("_rank")


def targeted(questions: DataFrame, weak: DataFrame, order: str, k: int = 5) -> DataFrame:
    """Variants aimed at vulnerable categories, plus impossible ones of the first
    ``k`` questions."""
    q = F.col("question")
    types = first_of_category(questions, weak, "query_type", order, k)
    levels = first_of_category(questions, weak, "complexity", order, k)
    first = questions.orderBy(order).limit(k)
    parts = [
        _apply(types, "paraphrase", targeted_paraphrase(q)),
        _apply(types, "irrelevant_context", targeted_irrelevant(q)),
        _apply(levels, "ambiguity", targeted_ambiguous(q)),
        _apply(first, "impossible", impossible(q)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
