"""Structure of paper text: front matter, sections, captions, references, citations.

A paper is one row. Everything here works inside that row with array functions, so
no paper is shuffled and a long paper costs no more than its own text; child tables
come out by exploding at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from qamill.functions import text as tx
from qamill.functions.rows import unnest

# The heading, caption and citation forms.
HEADING_FORMS = (
    r"Abstract[\s:]*$",
    r"\d+(?:\.\d+)*\.?\s+[A-Z][a-zA-Z\s]+[\s:]*$",
    r"[A-Z][a-zA-Z\s]+[\s:]*$",
    r"(?:Introduction|Background|Related Work|Methods?|Methodology|Experiments?"
    r"|Results|Discussion|Conclusion|References)[\s:]*$",
)
ANY_HEADING = "^(?:" + "|".join(HEADING_FORMS) + ")"
HEADING = "(?md)" + ANY_HEADING
FIGURE = r"Fig(?:ure)?\.?\s+\d+[\.:]?\s+[^\n.]+\."
TABLE_FORMS = (r"Table\s+\d+[\.:]?\s+[^\n.]+\.", r"Tab\.\s+\d+[\.:]?\s+[^\n.]+\.")
ONE_AUTHOR = r"[A-Za-z]+(?:\s+et\s+al\.)?(?:,\s+\d{4})?"
NUMBERED = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"
AUTHOR_YEAR = rf"\(\s*{ONE_AUTHOR}(?:\s*;\s*{ONE_AUTHOR})*\s*\)"
ABSTRACT = r"(?i)Abstract[:\s]*\n*([\s\S]+?)(?:\n\n|\n[A-Z][a-z]+\s+\d+\.|\n\d+\.)"
KEYWORDS = r"(?i)Keywords?[:\s]+([\s\S]+?)(?:\n\n|\.[^\w])"
BIBLIOGRAPHY = ("References", "Bibliography", r"Cited\s+Works")
AFTER_BIBLIOGRAPHY = r"(?is)\n\s*(?:Appendix|Supplementary|Acknowledgements).*\z"
MAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
AFFILIATION = r"\(\d+\)|\(\w+\)|\d+|[*†‡§]"


def bound(rule):
    """Compute the rule's text argument once per row, even if it is a long expression."""

    @functools.wraps(rule)
    def once(text: Column, *args, **kwargs) -> Column:
        return tx.bind(text, lambda t: rule(t, *args, **kwargs))

    return once


def full_text(pages: DataFrame) -> DataFrame:
    """``(paper_id, page, text)`` to one text per paper, pages parted by a blank line."""
    kept = pages.where(F.coalesce(F.length("text"), F.lit(0)) > 0)
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    return kept.groupBy("paper_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text"),
        F.min_by("text", "page").alias("first_page"),
    )


def _line(key: tuple, ix: int, line: list[tuple]) -> tuple:
    """(paper_id, page, line_ix, text, top, bottom, x0, x1) of words (top, x0, text, x1, bottom) as ``concat_ws`` and
    ``greatest`` would fold them: nulls are skipped, but a line of one word has its text as it is."""
    texts, bottoms = [w[2] for w in line], [w[4] for w in line if w[4] is not None]
    some = lambda items: [t for t in items if t is not None]
    text = texts[0] if len(line) == 1 else " ".join([" ".join(some(texts[:2])), *some(texts[2:])])
    lowest = next((b for b in bottoms if b != b), max(bottoms)) if bottoms else None
    return *key, ix, text, line[0][0], lowest, line[0][1], line[-1][3]


def _folded(batches: Iterator[pa.RecordBatch], tolerance: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Lines of sorted words (paper_id, page, top, x0, text, x1, bottom); only the line being read is held."""
    key, ix, line = None, 0, []
    for batch in batches:
        ends = sorted({n for c in ("paper_id", "page") for n in pc.run_end_encode(batch[c]).run_ends.to_pylist()})
        words = list(zip(*[batch[c].to_pylist() for c in ("top", "x0", "text", "x1", "bottom")]))
        out, start = [], 0
        for end in ends:
            here = (batch["paper_id"][start].as_py(), batch["page"][start].as_py())
            if line and here != key:
                out.append(_line(key, ix, line))
                line = []
            if here != key:
                key, ix = here, 0
            for word in words[start:end]:
                # nulls, NaN and the infinities are within reach of nothing
                if line and None not in (word[0], line[0][0]) and abs(word[0] - line[0][0]) <= tolerance:
                    line.append(word)
                else:
                    if line:
                        out.append(_line(key, ix, line))
                        ix += 1
                    line = [word]
            start = end
        yield _rows(out, schema)
    if line:
        yield _rows([_line(key, ix, line)], schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def words_to_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words of a page to lines.

    Words go by (top, x0). A word joins the line while its top is within
    ``tolerance`` of the line's first word, so slow drift does start a new line.
    The words of a page are sorted where they meet and read once, line by line; neither a page nor
    its words are ever held whole.
    """
    placed = words.select("paper_id", "page", *[F.col(c).cast("double").alias(c) for c in ("top", "x0")], "text",
                          *[F.col(c).cast("double").alias(c) for c in ("x1", "bottom")])
    ordered = placed.repartition("paper_id", "page").sortWithinPartitions(*placed.columns)
    schema = T.StructType([placed.schema["paper_id"], placed.schema["page"], T.StructField("line_ix", T.IntegerType()),
                           T.StructField("text", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("top", "bottom", "x0", "x1")]])
    return ordered.mapInArrow(functools.partial(_folded, tolerance=tolerance, schema=to_arrow_schema(schema)), schema)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), tx.strip)


@bound
def title(text: Column) -> Column:
    """The longest of the first three long lines among the first ten."""
    long = F.filter(F.slice(_lines(text), 1, 10), lambda x: F.length(x) > 10)
    ranked = F.transform(F.slice(long, 1, 3), lambda x, i: F.struct(
        (-F.length(x)).alias("n"), i.alias("ix"), x.alias("text")))
    return F.coalesce(F.array_min(ranked)["text"], F.lit(""))


@bound
def authors(text: Column) -> Column:
    """Names from the first line after the title that has a comma, @ or *."""
    head = F.slice(_lines(text), 2, 14)
    stop = F.array_position(F.transform(head, lambda x: F.contains(F.lower(x), F.lit("abstract"))), True)
    before = F.when(stop > 0, F.slice(head, 1, (stop - 1).cast("int"))).otherwise(head)
    line = F.get(F.filter(before, lambda x: x.rlike("[,@*]")), F.lit(0))
    line = F.regexp_replace(line, r"\s*,\s*|\s+and\s+|\s*&\s*", ",")
    line = F.regexp_replace(F.regexp_replace(line, MAIL, ""), AFFILIATION, "")
    names = F.transform(F.split(line, ","), tx.strip)
    return F.coalesce(F.filter(names, lambda x: F.length(x) > 2), F.array().cast("array<string>"))


@bound
def keywords(text: Column) -> Column:
    """P5."""
    found = tx.strip(F.regexp_extract(text, KEYWORDS, 1))
    return F.filter(F.transform(F.split(found, "[,;]"), tx.strip), lambda x: x != "")


@bound
def abstract(text: Column, first_page: Column | None = None) -> Column:
    """By pattern, else the lines after "Abstract" on page 1 up to a heading."""
    page = text if first_page is None else first_page
    at = F.locate("abstract", F.lower(page))
    lines = F.slice(F.transform(F.split(F.substring(page, at, F.length(page)), "\n"), tx.strip), F.lit(2), F.greatest(F.size(F.split(page, "\n")), F.lit(1)))
    is_head = lambda x: x.rlike(ANY_HEADING)
    stop = F.array_position(
        F.transform(lines, lambda x, i: is_head(x) | (
            (x == "") & F.coalesce(is_head(F.get(lines, i + 1)), F.lit(False)))), True)
    body = F.when(stop > 0, F.slice(lines, 1, (stop - 1).cast("int"))).otherwise(lines)
    scanned = F.when(at > 0, tx.strip(F.array_join(body, " ")))
    found = F.when(F.regexp_count(text, F.lit(ABSTRACT)) > 0, tx.strip(F.regexp_extract(text, ABSTRACT, 1)))
    return F.coalesce(found, scanned, F.lit(""))


def heading_level(heading: Column) -> Column:
    """Number of dotted numeric parts; 1 without a number."""
    number = F.regexp_extract(heading, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


@bound
def sections(text: Column) -> Column:
    """Headings and the text up to the next one; one "Main Content" without any."""
    heads = tx.spans(text, HEADING)
    whole = F.array(F.struct(
        F.lit("Main Content").alias("heading"), F.lit(1).alias("level"), tx.strip(text).alias("content"),
        F.lit(0).alias("start_offset"), F.length(text).alias("end_offset")))

    def cut(h: Column, i: Column, all_heads: Column) -> Column:
        heading = tx.strip(h["match"])
        end = F.coalesce(F.get(all_heads, i + 1)["start"], F.length(text))
        content = F.substring(text, h["end"] + 1, end - h["end"])
        return F.struct(heading.alias("heading"), heading_level(heading).alias("level"),
                        tx.strip(content).alias("content"), h["end"].alias("start_offset"),
                        end.alias("end_offset"))

    found = tx.bind(heads, lambda hs: F.transform(hs, lambda h, i: cut(h, i, hs)))
    return tx.bind(found, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def _mentions(low: Column, forms: list[str], number: Column) -> Column:
    counts = [tx.count_plain(low, F.concat(F.lit(f + " "), number)) for f in forms]
    return sum(counts[1:], counts[0]) - 1


@bound
def captions(text: Column, kind: str) -> Column:
    """Captions with position and the number of mentions besides the caption."""
    if kind == "figure":
        hits, number, forms = tx.spans(text, FIGURE), r"Fig(?:ure)?\.?\s+(\d+)", ["fig.", "figure"]
    else:
        hits = F.concat(*[tx.spans(text, p) for p in TABLE_FORMS])
        number, forms = r"Ta(?:b(?:le)?)?\.?\s+(\d+)", ["table", "tab."]

    def row(h: Column, low: Column) -> Column:
        n = F.regexp_extract(h["match"], number, 1)
        return F.struct(F.lit(kind).alias("kind"), n.alias("number"), tx.strip(h["match"]).alias("caption"),
                        h["start"].alias("position"), _mentions(low, forms, n).alias("reference_count"))

    return tx.bind(F.lower(text), lambda low: F.transform(hits, lambda h: row(h, low)))


def grid_records(grid: Column) -> Column:
    """P10: a cell grid (header row first) to records; blank rows dropped.

    Blank headers become ``Column_k``; of equal headers the last wins.
    """
    header = F.transform(grid[0], lambda h, k: F.coalesce(
        F.nullif(tx.strip(h), F.lit("")), F.concat(F.lit("Column_"), k.cast("string"))))
    wide = lambda row: F.slice(row, 1, F.size(header))

    def record(row: Column) -> Column:
        pairs = F.zip_with(F.slice(header, 1, F.size(wide(row))), wide(row), lambda h, c: F.struct(
            h.alias("key"), F.coalesce(tx.strip(c), F.lit("")).alias("value")))
        last = F.filter(pairs, lambda p, i: F.array_position(
            F.slice(F.transform(pairs, lambda q: q["key"]), i + 2, F.size(pairs)), p["key"]) == 0)
        return F.map_from_entries(last)

    rows = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), record)
    return F.filter(rows, lambda r: F.exists(F.map_values(r), lambda v: v != ""))


def attach_tables(table_captions: DataFrame, grids: DataFrame) -> DataFrame:
    """P10: give each grid to a caption.

    ``table_captions`` is ``(paper_id, number, position, caption, reference_count)``,
    ``grids`` is ``(paper_id, page, table_ix, grid)`` with ``table_ix`` from 1 per page.
    The n-th grid with index j goes to the n-th caption whose number is j; grids left
    over become tables of their own.
    """
    nth = F.row_number().over(W.partitionBy("paper_id", "number").orderBy("position"))
    caps = table_captions.withColumn("nth", nth)
    nth = F.row_number().over(W.partitionBy("paper_id", "number").orderBy("page"))
    data = (
        grids.where(F.size("grid") > 1)
        .select("paper_id", "page", F.col("table_ix").cast("string").alias("number"),
                grid_records(F.col("grid")).alias("data"))
        .withColumn("nth", nth)
    )
    both = caps.join(data, ["paper_id", "number", "nth"], "full")
    n_caps = table_captions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_caps"))
    extra = F.row_number().over(W.partitionBy("paper_id", F.col("caption").isNull()).orderBy(
        "page", F.col("number").cast("int")))
    return (
        both.where(F.col("caption").isNotNull() | (F.size("data") > 0))
        .join(n_caps, "paper_id", "left").withColumn("extra", extra)
        .select(
            "paper_id",
            F.when(F.col("caption").isNotNull(), F.concat(F.lit("table_"), "number")).otherwise(
                F.concat(F.lit("extracted_table_p"), F.col("page").cast("string"), F.lit("_"), "number")
            ).alias("table_id"),
            F.coalesce("caption", F.concat(F.lit("Extracted Table "), (
                F.coalesce("n_caps", F.lit(0)) + F.col("extra")).cast("string"))).alias("caption"),
            "data", F.coalesce("reference_count", F.lit(0)).alias("reference_count"),
        )
    )


@bound
def bibliography(text: Column) -> Column:
    """The reference region, up to an appendix; empty when there is none."""
    regions = [F.regexp_extract(text, rf"(?i){name}\s*\n([\s\S]+)\z", 1) for name in BIBLIOGRAPHY]
    region = tx.first_of(*regions)
    in_sections = F.get(F.filter(
        sections(text), lambda s: s["heading"].rlike(r"(?i)^References|^Bibliography|^Cited\s+Works")
    ), F.lit(0))["content"]
    return F.coalesce(tx.strip(F.regexp_replace(region, AFTER_BIBLIOGRAPHY, "")), in_sections, F.lit(""))


@bound
def split_references(region: Column) -> Column:
    """Entries as ``(id, text)``: ``[n]`` style, else author style, else by line."""
    number_form = F.lit(r"(?msd)^\s*\[(\d+)\]\s+(.+?)(?=\n\s*\[\d+\]|\z)")
    numbered = F.zip_with(
        F.regexp_extract_all(region, number_form, F.lit(1)),
        F.regexp_extract_all(region, number_form, F.lit(2)),
        lambda n, b: F.struct(n.alias("id"), tx.strip(b).alias("text")))
    author_form = r"(?msd)^\s*([A-Za-z\-]+,\s+[A-Za-z\.\s]+(?:,|and|&).+?)(?=\n[A-Za-z\-]+,|\z)"
    by_author = F.regexp_extract_all(region, F.lit(author_form), F.lit(1))
    lines = F.filter(_lines(region), lambda x: x != "")
    starts = r"^(?:\[\d+\]|[A-Za-z\-]+,\s+[A-Za-z\.\s]+,|\d+\.)"

    def fold(acc: Column, line: Column) -> Column:
        return F.when(
            (F.size(acc) == 0) | line.rlike(starts), F.concat(acc, F.array(line))
        ).otherwise(F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), line))))

    by_line = F.aggregate(lines, F.array().cast("array<string>"), fold)
    counted = lambda items: F.transform(items, lambda x, i: F.struct(
        (i + 1).cast("string").alias("id"), tx.strip(x).alias("text")))
    return F.when(F.size(numbered) > 0, numbered).when(
        F.size(by_author) > 0, counted(by_author)).otherwise(counted(by_line))


def parse_reference(text: Column) -> Column:
    """The nine fields of one reference text."""
    ref = tx.strip(F.regexp_replace(text, r"^\s*(?:\[\d+\]|\d+\.\s+)", ""))
    form = r"\((\d{4})\)|,\s*(\d{4})\s*[,\.]"
    return tx.bind(ref, lambda r: tx.bind(
        tx.first_of(F.regexp_extract(r, form, 1), F.regexp_extract(r, form, 2)),
        lambda year: tx.bind(
            F.substring(r, _after(r, year), F.length(r)), lambda after: _fields(r, year, after))))


def _fields(ref: Column, year: Column, after: Column) -> Column:
    doi = F.regexp_replace(F.regexp_extract(ref, r"(?i)doi:?\s*(\S+)", 1), r"\.+\z", "")
    url = F.regexp_replace(F.regexp_extract(ref, r"https?://\S+", 0), r"\.+\z", "")
    lead = F.regexp_extract(ref, r"^([^\.]+)\.\s+", 1)
    names = F.filter(F.transform(
        F.split(lead, r",\s+(?:and|&)|\s+(?:and|&)\s+|,\s+"), tx.strip), lambda x: x != "")
    titled = r"^[,\.\s]*([^\.]+)\.\s+"
    found = F.regexp_extract(after, titled, 0) != ""
    rest = tx.strip(F.regexp_replace(after, titled, ""))
    numbers = r"(\d+)[^\d]*(\d+)[^\d]*(\d+(?:-\d+)?)"
    part = lambda c: F.when(year.isNotNull() & found, c).otherwise("")
    return F.struct(
        names.alias("authors"), year.alias("year"),
        part(tx.strip(F.regexp_extract(after, titled, 1))).alias("title"),
        part(tx.strip(F.regexp_extract(rest, r"^([^,]+)", 1))).alias("journal"),
        part(F.regexp_extract(rest, numbers, 1)).alias("volume"),
        part(F.regexp_extract(rest, numbers, 2)).alias("issue"),
        part(F.regexp_extract(rest, numbers, 3)).alias("pages"),
        doi.alias("doi"), url.alias("url"),
    )


def _after(text: Column, term: Column) -> Column:
    """Position just past the first ``term``, 1 when it is null."""
    at = F.position(F.coalesce(term, F.lit("")), text)
    return F.when(term.isNull() | (at == 0), 1).otherwise(at + F.length(term))


@bound
def citations(text: Column) -> Column:
    """Numbered, then author-year citations with ids, position and context."""

    def row(h: Column, numeric: bool) -> Column:
        inner = tx.strip(F.substring(h["match"], F.lit(2), F.length(h["match"]) - 2))
        ids = F.transform(F.split(inner, "," if numeric else r"\s*;\s*"), tx.strip)
        low = F.greatest(h["start"] - 50, F.lit(0))
        return F.struct(
            h["match"].alias("text"), F.filter(ids, lambda x: x != "").alias("ref_ids"),
            h["start"].alias("position"),
            F.substring(text, low + 1, h["end"] + 50 - low).alias("context"))

    return F.concat(F.transform(tx.spans(text, NUMBERED), lambda h: row(h, True)),
                    F.transform(tx.spans(text, AUTHOR_YEAR), lambda h: row(h, False)))


def link_citations(cited: DataFrame, bib: DataFrame) -> DataFrame:
    """Every cited id with its reference text; null text means dangling."""
    ids = cited.select("paper_id", "position", F.explode("ref_ids").alias("id"))
    return ids.join(bib.select("paper_id", "id", F.col("text").alias("reference")), ["paper_id", "id"], "left")


def structure(papers: DataFrame) -> DataFrame:
    """Every part of the papers next to their ``(paper_id, full_text)``."""
    text = F.col("full_text")
    entries = split_references(bibliography(text))
    return papers.select(
        "*", title(text).alias("title"), authors(text).alias("authors"),
        keywords(text).alias("keywords"), abstract(text).alias("abstract"),
        sections(text).alias("sections"), captions(text, "figure").alias("figures"),
        captions(text, "table").alias("tables"),
        F.transform(entries, lambda e: F.struct(
            e["id"].alias("id"), e["text"].alias("text"), parse_reference(e["text"]).alias("parsed")
        )).alias("references"),
        citations(text).alias("citations"),
    )


def child(papers: DataFrame, column: str, ix: str | None = None) -> DataFrame:
    """One row per element of a nested part."""
    rows = unnest(papers, column, ["paper_id"], ix)
    return rows.select("paper_id", *([ix] if ix else []), "item.*")
