"""Registered queries: paper structure (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.operators import papers as pa
from qamill.plans.fixtures import cte, table, view

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def papers(spark, sf):
    return view(spark, sf, "v_papers").select(F.col("doc_id").alias("paper_id"), "full_text")


P = cte("v_papers")
SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"
STRIP = rf"'^[{SP}]+|[{SP}]+\z', '', 'g'"
HEAD = "(?m)" + pa.ANY_HEADING
LINES = f"list_transform(string_split(full_text, chr(10)), lambda x: regexp_replace(x, {STRIP}))"


@query("paper_text", """
SELECT conv_id AS paper_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS full_text
FROM conversations WHERE length(text) > 0 GROUP BY conv_id""")
def paper_text(spark, sf):
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("paper_id"), F.col("turn").alias("page"), "text")
    return pa.full_text(pages).select("paper_id", F.md5("full_text").alias("full_text"))


@query("word_lines")
def word_lines(spark, sf):
    """Words of every document set on a drifting grid, then folded to lines."""
    words = table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_id"), F.lit(1).alias("page"),
        F.posexplode(F.split("text", " ")).alias("i", "text"))
    placed = words.select(
        "paper_id", "page", "text", (F.floor(F.col("i") / 7) * 8 + F.col("i") % 7 * 0.7).cast("double").alias("top"),
        (F.col("i") % 7 * 10).cast("double").alias("x0"), (F.col("i") % 7 * 10 + 9).cast("double").alias("x1"),
        (F.floor(F.col("i") / 7) * 8 + 6).cast("double").alias("bottom"))
    return pa.words_to_lines(placed).select("paper_id", "page", "line_ix", F.md5("text").alias("line"), "top", "bottom")


@query("paper_title", f"""{P},
l AS (SELECT doc_id, list_filter(({LINES})[1:10], lambda x: length(x) > 10)[1:3] AS c FROM v_papers)
SELECT doc_id AS paper_id, coalesce(list_filter(c, lambda x: length(x) = list_max(list_transform(c, lambda y: length(y))))[1], '') AS title FROM l""")
def paper_title(spark, sf):
    return papers(spark, sf).select("paper_id", pa.title(F.col("full_text")).alias("title"))


@query("paper_authors", f"""{P},
l AS (SELECT doc_id, ({LINES})[2:15] AS c FROM v_papers),
s AS (SELECT doc_id, c, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: contains(lower(c[i]), 'abstract'))), len(c) + 1) AS stop FROM l),
a AS (SELECT doc_id, list_filter(c[1:stop - 1], lambda x: regexp_matches(x, '[,@*]'))[1] AS line FROM s),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(line, '\\s*,\\s*|\\s+and\\s+|\\s*&\\s*', ',', 'g'),
   '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+', '', 'g'), '\\(\\d+\\)|\\(\\w+\\)|\\d+|[*†‡§]', '', 'g') AS line FROM a)
SELECT doc_id AS paper_id, coalesce(array_to_string(list_filter(list_transform(string_split(line, ','), lambda x: regexp_replace(x, {STRIP})), lambda x: length(x) > 2), '|'), '') AS authors FROM b""")
def paper_authors(spark, sf):
    return papers(spark, sf).select("paper_id", F.array_join(pa.authors(F.col("full_text")), "|").alias("authors"))


@query("paper_keywords", f"""{P}
SELECT doc_id AS paper_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(
  regexp_extract(full_text, '(?i)Keywords?[:\\s]+([\\s\\S]+?)(?:\\n\\n|\\.[^\\w])', 1), {STRIP}), '[,;]'),
  lambda x: regexp_replace(x, {STRIP})), lambda x: x <> ''), '|') AS keywords FROM v_papers""")
def paper_keywords(spark, sf):
    return papers(spark, sf).select("paper_id", F.array_join(pa.keywords(F.col("full_text")), "|").alias("keywords"))


@query("paper_abstract", f"""{P}
SELECT doc_id AS paper_id, regexp_replace(regexp_extract(full_text,
  '(?i)Abstract[:\\s]*\\n*([\\s\\S]+?)(?:\\n\\n|\\n[A-Z][a-z]+\\s+\\d+\\.|\\n\\d+\\.)', 1), {STRIP}) AS abstract FROM v_papers""")
def paper_abstract(spark, sf):
    return papers(spark, sf).select("paper_id", pa.abstract(F.col("full_text")).alias("abstract"))


SECTIONS_SQL = f"""
cut AS (SELECT doc_id, full_text, regexp_extract_all(full_text, '{HEAD}') AS heads,
               string_split_regex(full_text, '{HEAD}') AS parts FROM v_papers),
sec AS (SELECT doc_id, i - 1 AS section_ix, regexp_replace(heads[i], {STRIP}) AS heading,
          CASE WHEN regexp_matches(trim(heads[i]), '^\\d') THEN len(string_split(regexp_extract(regexp_replace(heads[i], {STRIP}), '^(\\d+(?:\\.\\d+)*)', 1), '.')) ELSE 1 END AS level,
          regexp_replace(parts[i + 1], {STRIP}) AS content,
          list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(heads[1:i], lambda x: length(x))) AS start_offset,
          list_sum(list_transform(parts[1:i + 1], lambda x: length(x))) + list_sum(list_transform(heads[1:i], lambda x: length(x))) AS end_offset
        FROM (SELECT *, unnest(range(1, len(heads) + 1)) AS i FROM cut) c
        UNION ALL SELECT doc_id, 0, 'Main Content', 1, regexp_replace(full_text, {STRIP}), 0, length(full_text) FROM cut WHERE len(heads) = 0)
"""


@query("paper_sections", f"""{P}, {SECTIONS_SQL}
SELECT doc_id AS paper_id, section_ix, heading, level, md5(content) AS content,
       CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset FROM sec""")
def paper_sections(spark, sf):
    rows = papers(spark, sf).select("paper_id", pa.sections(F.col("full_text")).alias("sections"))
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return pa.child(rows, "sections", "section_ix").select(
        "paper_id", big("section_ix"), "heading", big("level"), F.md5("content").alias("content"),
        big("start_offset"), big("end_offset"))


def _captions_sql(kind: str, forms: list[str], number: str, marks: tuple[str, str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, full_text, unnest(regexp_extract_all(full_text, '{f}')) AS caption FROM v_papers" for f in forms)
    gone = lambda m: (f"(length(full_text) - length(replace(lower(full_text), concat('{m} ', n), '')))"
                      f" // (length(concat('{m} ', n)))")
    return f"""{P}, c AS ({parts}),
d AS (SELECT doc_id, full_text, regexp_replace(caption, {STRIP}) AS caption, regexp_extract(caption, '{number}', 1) AS n FROM c)
SELECT doc_id AS paper_id, n AS number, caption, {gone(marks[0])} + {gone(marks[1])} - 1 AS reference_count FROM d"""


@query("figure_captions", _captions_sql("figure", [pa.FIGURE], r"Fig(?:ure)?\.?\s+(\d+)", ("fig.", "figure")))
def figure_captions(spark, sf):
    rows = papers(spark, sf).select("paper_id", pa.captions(F.col("full_text"), "figure").alias("items"))
    return pa.child(rows, "items").select("paper_id", "number", "caption", F.col("reference_count").cast("bigint").alias("reference_count"))


@query("table_captions", _captions_sql("table", list(pa.TABLE_FORMS), r"Ta(?:b(?:le)?)?\.?\s+(\d+)", ("table", "tab.")))
def table_captions(spark, sf):
    rows = papers(spark, sf).select("paper_id", pa.captions(F.col("full_text"), "table").alias("items"))
    return pa.child(rows, "items").select("paper_id", "number", "caption", F.col("reference_count").cast("bigint").alias("reference_count"))


@query("table_records", """
WITH g AS (SELECT o_custkey, 1 + o_custkey % 3 AS table_ix, count(*) AS n_rows FROM orders GROUP BY ALL)
SELECT o_custkey AS paper_id, CASE WHEN table_ix <= 2 THEN concat('table_', CAST(table_ix AS STRING)) ELSE 'extracted_table_p1_3' END AS table_id,
       CASE WHEN table_ix <= 2 THEN concat('Table ', CAST(table_ix AS STRING)) ELSE 'Extracted Table 3' END AS caption, n_rows
FROM g
UNION ALL SELECT o_custkey, concat('table_', CAST(k AS STRING)), concat('Table ', CAST(k AS STRING)), NULL
FROM g CROSS JOIN (SELECT unnest([1, 2]) AS k) x WHERE k <> table_ix""")
def table_records(spark, sf):
    """One grid per customer, from its orders, against two captions each."""
    orders = table(spark, sf, "orders")
    cell = lambda c: F.col(c).cast("string")
    grids = (
        orders.groupBy(F.col("o_custkey").alias("paper_id"))
        .agg(F.sort_array(F.collect_list(F.array(cell("o_orderkey"), cell("o_totalprice"), F.lit(None).cast("string")))).alias("rows"))
        .select("paper_id", F.lit(1).alias("page"), (1 + F.col("paper_id") % 3).cast("int").alias("table_ix"),
                F.concat(F.array(F.array(F.lit("key"), F.lit(" price "), F.lit(""))), F.col("rows")).alias("grid"))
    )
    captions = orders.select(F.col("o_custkey").alias("paper_id")).distinct().select(
        "paper_id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("number")).select(
        "paper_id", "number", F.lit(0).alias("position"),
        F.concat(F.lit("Table "), "number").alias("caption"), F.lit(1).alias("reference_count"))
    return pa.attach_tables(captions, grids).select(
        "paper_id", "table_id", "caption", F.when(F.col("data").isNotNull(), F.size("data")).cast("bigint").alias("n_rows"))


BIB_SQL = f"""
region AS (SELECT doc_id, regexp_extract(full_text, '(?i)References\\s*\\n([\\s\\S]+)\\z', 1) AS t FROM v_papers),
bib AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^\\s*\\[(\\d+)\\]\\s+', 1)) AS id,
               unnest(list_transform(string_split_regex(t, '(?m)^\\s*\\[\\d+\\]\\s+')[2:], lambda x: regexp_replace(x, {STRIP}))) AS text FROM region)
"""


def _entries(spark, sf):
    rows = papers(spark, sf).select("paper_id", pa.split_references(pa.bibliography(F.col("full_text"))).alias("items"))
    return pa.child(rows, "items")


@query("bib_split", f"{P}, {BIB_SQL} SELECT doc_id AS paper_id, id, text FROM bib")
def bib_split(spark, sf):
    return _entries(spark, sf).select("paper_id", "id", "text")


@query("bib_fields", f"""{P}, {BIB_SQL},
y AS (SELECT *, nullif(coalesce(nullif(regexp_extract(text, '\\((\\d{{4}})\\)|,\\s*(\\d{{4}})\\s*[,\\.]', 1), ''), regexp_extract(text, '\\((\\d{{4}})\\)|,\\s*(\\d{{4}})\\s*[,\\.]', 2)), '') AS year FROM bib),
a AS (SELECT *, CASE WHEN year IS NULL THEN text ELSE substring(text, instr(text, year) + 4) END AS after FROM y),
f AS (SELECT *, regexp_matches(after, '^[,\\.\\s)]*([^\\.]+)\\.\\s+') AND year IS NOT NULL AS has FROM a),
r AS (SELECT *, regexp_replace(after, '^[,\\.\\s]*([^\\.]+)\\.\\s+', '') AS rest FROM f)
SELECT doc_id AS paper_id, id, year,
  array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(text, '^([^\\.]+)\\.\\s+', 1), ',\\s+(?:and|&)|\\s+(?:and|&)\\s+|,\\s+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors,
  CASE WHEN has THEN trim(regexp_extract(after, '^[,\\.\\s]*([^\\.]+)\\.\\s+', 1)) ELSE '' END AS title,
  CASE WHEN has THEN trim(regexp_extract(rest, '^([^,]+)', 1)) ELSE '' END AS journal,
  CASE WHEN has THEN regexp_extract(rest, '(\\d+)[^\\d]*(\\d+)[^\\d]*(\\d+(?:-\\d+)?)', 1) ELSE '' END AS volume,
  CASE WHEN has THEN regexp_extract(rest, '(\\d+)[^\\d]*(\\d+)[^\\d]*(\\d+(?:-\\d+)?)', 2) ELSE '' END AS issue,
  CASE WHEN has THEN regexp_extract(rest, '(\\d+)[^\\d]*(\\d+)[^\\d]*(\\d+(?:-\\d+)?)', 3) ELSE '' END AS pages,
  regexp_replace(regexp_extract(text, '(?i)doi:?\\s*(\\S+)', 1), '\\.+\\z', '') AS doi,
  regexp_replace(regexp_extract(text, 'https?://\\S+'), '\\.+\\z', '') AS url
FROM r""")
def bib_fields(spark, sf):
    rows = _entries(spark, sf).select("paper_id", "id", pa.parse_reference(F.col("text")).alias("p"))
    return rows.select("paper_id", "id", F.array_join("p.authors", "|").alias("authors"), "p.year", "p.title",
                       "p.journal", "p.volume", "p.issue", "p.pages", "p.doi", "p.url")


CITE_SQL = f"""
cc AS (SELECT doc_id, full_text, regexp_extract_all(full_text, '{{0}}') AS hits, string_split_regex(full_text, '{{0}}') AS parts FROM v_papers),
ci AS (SELECT doc_id, hits[i] AS text, full_text,
         list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS position
       FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cc) x)
"""


def _citations_sql():
    out = []
    for pattern, sep in ((pa.NUMBERED, ","), (pa.AUTHOR_YEAR, ";")):
        out.append(f"""SELECT doc_id AS paper_id, text, CAST(position AS BIGINT) AS position,
  array_to_string(list_transform(string_split(text[2:-2], '{sep}'), lambda x: trim(x)), '|') AS ref_ids,
  substring(full_text, CAST(greatest(position - 50, 0) + 1 AS BIGINT), CAST(position + length(text) + 50 - greatest(position - 50, 0) AS BIGINT)) AS context
FROM (WITH {CITE_SQL.replace('{0}', pattern)} SELECT * FROM ci) s""")
    return f"{P} {' UNION ALL '.join(out)}"


@query("citations", _citations_sql())
def citations(spark, sf):
    rows = papers(spark, sf).select("paper_id", pa.citations(F.col("full_text")).alias("items"))
    return pa.child(rows, "items").select(
        "paper_id", "text", F.col("position").cast("bigint").alias("position"),
        F.array_join("ref_ids", "|").alias("ref_ids"), "context")


@query("citation_links", f"""{P}, {BIB_SQL}, {CITE_SQL.replace('{0}', pa.NUMBERED)},
ids AS (SELECT doc_id, CAST(position AS BIGINT) AS position, unnest(list_transform(string_split(text[2:-2], ','), lambda x: trim(x))) AS id FROM ci)
SELECT ids.doc_id AS paper_id, ids.id, position, bib.text AS reference FROM ids LEFT JOIN bib ON bib.doc_id = ids.doc_id AND bib.id = ids.id""")
def citation_links(spark, sf):
    rows = papers(spark, sf).select("paper_id", pa.citations(F.col("full_text")).alias("items"))
    cited = pa.child(rows, "items").where(F.col("text").startswith("["))
    return pa.link_citations(cited, _entries(spark, sf)).select(
        "paper_id", "id", F.col("position").cast("bigint").alias("position"), "reference")


@query("paper_assembly", f"""{P}, {SECTIONS_SQL}, {BIB_SQL}
SELECT p.doc_id AS paper_id, s.n AS n_sections, b.n AS n_references,
       len(regexp_extract_all(full_text, '{pa.NUMBERED}')) + len(regexp_extract_all(full_text, '{pa.AUTHOR_YEAR}')) AS n_citations
FROM v_papers p JOIN (SELECT doc_id, count(*) AS n FROM sec GROUP BY doc_id) s ON s.doc_id = p.doc_id
JOIN (SELECT doc_id, count(*) AS n FROM bib GROUP BY doc_id) b ON b.doc_id = p.doc_id""")
def paper_assembly(spark, sf):
    count = lambda c: F.size(c).cast("bigint")
    return pa.structure(papers(spark, sf)).select(
        "paper_id", count("sections").alias("n_sections"), count("references").alias("n_references"),
        count("citations").alias("n_citations"))
