"""Text as columns: cleaning, tokens, sentences, set similarity, regex spans.

Character classes are spelled out, because Java's ``\\w`` and ``\\s`` are ASCII
while the rules here are meant for all scripts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# The same white space as characters, for trimming without a regex.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
MARK = "\ue000"  # private-use character that parts matches from gaps
SENTENCE_GAP = rf"(?<=[.!?])[{SPACE}]+"


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank."""
    return F.regexp_replace(text, rf"[{SPACE}]+", " ")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


def clean(text: Column, drop_special: bool = False) -> Column:
    """Squeeze white space, optionally drop all but words and ``.,?!-``."""
    out = squeeze(text)
    if drop_special:
        out = F.regexp_replace(out, rf"[^{WORD}{SPACE}.,?!-]", "")
    return F.trim(out)


def words(text: Column) -> Column:
    """Split on white space, no empty items."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda x: x != "")


def tokens_strip(text: Column) -> Column:
    """M1: lower, delete punctuation, split (``don't`` gives ``dont``)."""
    return words(F.regexp_replace(F.lower(text), rf"[^{WORD}{SPACE}]", ""))


def tokens_word(text: Column) -> Column:
    """Lowered maximal runs of word characters (``don't`` gives ``don``, ``t``)."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+"), F.lit(0))


def tokens_rouge(text: Column, letters: str = "a-z0-9") -> Column:
    """Lowered runs of ``letters``; pass ``\\p{L}\\p{N}`` to keep all scripts."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{letters}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences: a gap is white space after ``.``, ``!`` or ``?``."""
    return F.filter(F.split(text, SENTENCE_GAP), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """M2/M3: shared over all distinct tokens of two arrays, 0 when one is empty."""

    def share(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        shared = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(
            shared / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))

    return bind(F.struct(a.alias("x"), b.alias("y")), share)


def ngrams(tokens: Column, n: int) -> Column:
    """Array of ``n``-grams, each joined by a blank."""

    def cut(t: Column) -> Column:
        # Elements by index: slicing inside the loop would copy the array each time.
        return F.transform(
            F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))),
            lambda x, i: F.concat_ws(" ", x, *[F.get(t, i + j) for j in range(1, n)]),
        )

    return tokens if n == 1 else bind(tokens, cut)


SCAN = 256  # even: pieces scanned at a time


def starts(pieces: Column) -> Column:
    """Where each of the pieces of a text begins.

    A fold that grows an array copies it at every step. The pieces are therefore scanned in runs
    of ``SCAN``, whose own starts come from a fold over the runs: 256 times fewer copies.
    """
    of_run = lambda at, run: F.aggregate(
        run, F.struct(at.alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["pos"] + F.length(p)).alias("pos"),
                                F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
        lambda acc: acc["out"])
    count = lambda p: F.greatest(F.ceil(F.size(p) / SCAN).cast("int"), F.lit(1))
    cut = lambda p: F.transform(F.sequence(F.lit(0), count(p) - 1), lambda i: F.slice(p, i * SCAN + 1, SCAN))
    size = lambda run: F.aggregate(run, F.lit(0), lambda a, p: a + F.length(p))

    def scan(runs: Column) -> Column:
        heads = F.aggregate(
            runs, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
            lambda acc, run: F.struct((acc["pos"] + size(run)).alias("pos"),
                                      F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.zip_with(heads, runs, of_run))

    return bind(pieces, lambda p: bind(cut(p), scan))


def spans(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as ``(match, start, end)``, offsets from 0.

    One regex pass sets a mark around each match; cutting at the marks gives gap,
    match, gap, … and their lengths add up to exact offsets. A text that holds the
    mark itself takes two passes, one for the gaps and one for the matches.
    """
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, h)))
    plain = F.filter(pairs, lambda x: x.isNotNull())
    pieces = F.when(F.contains(text, F.lit(MARK)), plain).otherwise(marked)
    hit = lambda piece, at: F.struct(
        piece.alias("match"), at.alias("start"), (at + F.length(piece)).alias("end"))
    return bind(pieces, lambda p: F.filter(
        F.zip_with(p, starts(p), hit), lambda x, i: i % 2 == 1))


def count_plain(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` as plain text."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("int")).otherwise(0)


def quoted(term: Column) -> Column:
    """``term`` as a regex literal."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def first_of(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
