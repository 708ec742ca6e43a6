"""Registered queries: documents, chunks, splits, sinks, cache (S*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qamill.functions import text as tx
from qamill.operators import corpus as co
from qamill.operators import markup as mk
from qamill.plans.corpus_build import CorpusOptions, build
from qamill.plans.fixtures import cte, table, view
from qamill.sources import cache, documents, results, sinks

QUERIES, ORACLES = {}, {}
SP = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


PATHS_SQL = """
SELECT page_id, concat('/data/', CAST(page_id AS STRING), '.',
  CASE page_id % 9 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'pdf' WHEN 3 THEN 'HTML' WHEN 4 THEN 'docx'
                   WHEN 5 THEN 'csv' WHEN 6 THEN 'json' WHEN 7 THEN 'exe' ELSE 'htm' END) AS path
FROM {pages}"""


@query("format_dispatch", f"""
WITH p AS ({PATHS_SQL.format(pages='pages')}),
r AS (SELECT CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))
  WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'rst' THEN 'text' WHEN 'pdf' THEN 'pdf'
  WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'doc' THEN 'word' WHEN 'docx' THEN 'word'
  WHEN 'csv' THEN 'structured' WHEN 'xls' THEN 'structured' WHEN 'xlsx' THEN 'structured'
  WHEN 'json' THEN 'data' WHEN 'xml' THEN 'data' WHEN 'yaml' THEN 'data' END AS format FROM p)
SELECT format, count(*) AS n FROM r WHERE format IS NOT NULL GROUP BY format""")
def format_dispatch(spark, sf):
    paths = spark.sql(PATHS_SQL, pages=table(spark, sf, "pages"))
    return (paths.select(co.route(F.col("path")).alias("format")).where("format IS NOT NULL")
            .groupBy("format").agg(F.count(F.lit(1)).alias("n")))


@query("document_ids", """
SELECT page_id, substring(md5(concat(url, ':', CAST(page_id AS STRING))), 1, 12) AS doc_id FROM pages""")
def document_ids(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", co.document_id(F.col("url"), F.col("page_id")).alias("doc_id"))


@query("clean_text", f"""
SELECT doc_id, md5(trim(regexp_replace(text, '[{SP}]+', ' ', 'g'))) AS cleaned,
  md5(trim(regexp_replace(regexp_replace(text, '[{SP}]+', ' ', 'g'),
      '[^\\p{{L}}\\p{{N}}_{SP}.,?!-]', '', 'g'))) AS plain
FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.clean(F.col("text"))).alias("cleaned"),
        F.md5(tx.clean(F.col("text"), drop_special=True)).alias("plain"))


@query("chunk_chars", """
SELECT doc_id, i AS chunk_ix, md5(substring(text, i * 900 + 1, 1000)) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 900) AS BIGINT))) AS i
      FROM documents WHERE length(text) > 0) d""")
def chunk_chars(spark, sf):
    return co.chunk(table(spark, sf, "documents")).select(
        "doc_id", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), F.md5("text").alias("chunk"))


SENT_SQL = rf"""list_filter(string_split(regexp_replace(text, '([.!?])[{SP}]+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '')"""


@query("chunk_sentences", f"""
WITH RECURSIVE s AS (SELECT doc_id, {SENT_SQL} AS items FROM documents),
walk AS (
  SELECT doc_id, items, 0 AS ix, CAST([] AS VARCHAR[]) AS cur, CAST(NULL AS VARCHAR) AS done FROM s
  UNION ALL
  SELECT doc_id, items, ix + 1,
    CASE WHEN ix = len(items) THEN cur WHEN is_full THEN list_append(cur[len(cur) - keep + 1:], items[ix + 1]) ELSE list_append(cur, items[ix + 1]) END,
    CASE WHEN (is_full OR ix = len(items)) AND len(cur) > 0 THEN array_to_string(cur, ' ') END
  FROM (SELECT *, ix < len(items) AND len(cur) > 0 AND total + length(items[ix + 1]) > 1000 AS is_full,
          coalesce(list_max(list_filter(range(1, len(cur) + 1), lambda k:
            list_sum(list_transform(cur[len(cur) - k + 1:], lambda x: length(x))) <= 100)), 0) AS keep
        FROM (SELECT *, coalesce(list_sum(list_transform(cur, lambda x: length(x))), 0) AS total FROM walk
              WHERE ix <= len(items)) w) w2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS chunk_ix, md5(done) AS chunk
FROM walk WHERE done IS NOT NULL""")
def chunk_sentences(spark, sf):
    return co.chunk(table(spark, sf, "documents"), by="sentences").select(
        "doc_id", F.col("chunk_ix").cast("bigint").alias("chunk_ix"), F.md5("text").alias("chunk"))


@query("chunk_document_ids", """
SELECT concat('d', CAST(doc_id AS STRING)) AS doc_id, CAST(ceil(length(text) / 900) AS BIGINT) AS n
FROM documents WHERE length(text) > 0""")
def chunk_document_ids(spark, sf):
    docs = table(spark, sf, "documents").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    names = co.chunk(docs).select(co.chunk_document_id(F.col("chunk_name")).alias("doc_id"))
    return names.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


PAGE_SQL = r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', '', 'g'),
    '(?is)<head\b.*?</head\s*>', '', 'g'),
    '(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|aside|blockquote|pre|form|figure)\b[^>]*>', chr(10), 'g'),
    '</?[a-zA-Z!][^>]*>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
  '[ \t\r\x0B\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')) AS text
FROM pages"""


@query("html_text", PAGE_SQL)
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(co.html_text(F.col("html"))).alias("text"))


# the rules leave references they do not list; the reader decodes all, of which the pages have these
READ_SQL = PAGE_SQL.replace("(html,", "(replace(replace(html, '&copy;', '©'), '&middot;', '·'),", 1)


@query("page_text", READ_SQL)
def page_text(spark, sf):
    """The one-pass reader; on plain pages it gives what the rules give, with every reference decoded."""
    return table(spark, sf, "pages").select("page_id", F.md5(mk.page_text("html")).alias("text"))


# Every kind of markup that a page may wrap its text in, and what is seen of it.
WRAPPED = [
    ("<!-- a > b --><p title=\"x > y\">", "</p>"), ("<script>if (a < b) { '</p>' }</script><div data-a='>'>", ""),
    ("<style>p > a {}</style>&#65;&#x42;&hellip; <b>", "</b> 1 < 2"), ("<textarea><i></textarea><br/>", "<script>open"),
]
SEEN = [("", ""), ("", ""), ("AB\u2026 ", " 1 < 2"), ("<i>\n", "")]


@query("page_markup", "WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t\\r\\x0B\\f\\xA0]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)\n"
       "SELECT doc_id, md5(CASE doc_id % 4 " + " ".join(
           f"WHEN {i} THEN concat('{a}', t, '{b}')" for i, (a, b) in enumerate(SEEN)) + " END) AS text FROM d")
def page_markup(spark, sf):
    """Whole texts inside pages with comments, quoted attributes, raw text, references and open tags."""
    docs = table(spark, sf, "documents")
    part = lambda at: F.get(F.array(*[F.lit(w[at]) for w in WRAPPED]), (F.col("doc_id") % 4).cast("int"))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return docs.select("doc_id", F.md5(mk.page_text(F.concat(part(0), escaped, part(1)))).alias("text"))


@query("decoded_formats", f"""
WITH t AS ({READ_SQL})
SELECT concat('/data/p', CAST(page_id AS STRING), '.html') AS path, 'html' AS format, text FROM t
UNION ALL SELECT concat('/data/d', CAST(doc_id AS STRING), '.md'), 'text', md5(text) FROM documents
UNION ALL SELECT concat('/data/e', CAST(event_id AS STRING), '.json'), 'data', md5(props) FROM events WHERE props IS NOT NULL""")
def decoded_formats(spark, sf):
    """Files of all formats that are decoded, as one table; others are dropped."""
    file = lambda name, key, text, ending: table(spark, sf, name).select(
        F.concat(F.lit("/data/" + name[0]), F.col(key).cast("string"), F.lit(ending)).alias("original_path"),
        F.lit(ending).alias("original_extension"), F.encode(F.col(text), "UTF-8").alias("content"))
    files = file("pages", "page_id", "html", ".html").unionByName(file("documents", "doc_id", "text", ".md")).unionByName(
        file("events", "event_id", "props", ".json")).unionByName(file("pages", "page_id", "html", ".exe"))
    return documents.decode_documents(files).select(
        F.col("original_path").alias("path"), "format", F.md5("text").alias("text"))


@query("record_text", """
SELECT conv_id, turn, md5(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text})) AS text
FROM conversations""")
def record_text(spark, sf):
    return documents.with_text(
        table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text"))
    ).select("conv_id", "turn", F.md5("text").alias("text"))


def _split_sql(partition: str) -> str:
    return f"""{cte('v_strata')},
r AS (SELECT *, row_number() OVER ({partition} ORDER BY pick, doc_id) AS rn, count(*) OVER ({partition}) AS n FROM v_strata),
t AS (SELECT *, floor(n * 0.7) AS n_train FROM r)
SELECT doc_id, CASE WHEN rn <= n_train THEN 'train'
  WHEN rn <= n_train + floor((n - n_train) * 0.5) THEN 'val' ELSE 'test' END AS split FROM t"""


@query("random_split", _split_sql(""))
def random_split(spark, sf):
    return co.assign_splits(view(spark, sf, "v_strata").select("doc_id")).select("doc_id", "split")


@query("stratified_split", _split_sql("PARTITION BY stratum"))
def stratified_split(spark, sf):
    docs = view(spark, sf, "v_strata").select("doc_id", "stratum")
    return co.assign_splits(docs, stratum="stratum").select("doc_id", "split")


@query("split_sizes", f"""WITH s AS ({_split_sql('PARTITION BY stratum')})
SELECT stratum, split, count(*) AS n FROM s JOIN (SELECT CAST(doc_id AS STRING) AS id, coalesce(lang, 'unknown') AS stratum FROM documents) d
ON s.doc_id = d.id GROUP BY stratum, split""")
def split_sizes(spark, sf):
    docs = view(spark, sf, "v_strata").select("doc_id", "stratum")
    return co.split_sizes(co.assign_splits(docs, stratum="stratum"), "stratum")


@query("split_members", f"""WITH s AS ({_split_sql('')})
SELECT split, sum(ceil(length(text) / 900)) AS n_chunks, count(*) AS n_docs
FROM s JOIN documents d ON s.doc_id = CAST(d.doc_id AS STRING) WHERE length(text) > 0 GROUP BY split""")
def split_members(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    members = co.chunk(co.assign_splits(docs), keep=["split"])
    return (members.groupBy("split", "doc_id").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("split").agg(F.sum("n").cast("double").alias("n_chunks"), F.count(F.lit(1)).alias("n_docs")))


@query("review_sample", f"""{cte('v_strata')},
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY pick, doc_id) AS rn,
             count(*) OVER (PARTITION BY stratum) AS n FROM v_strata)
SELECT doc_id, stratum FROM r WHERE rn <= greatest(ceil(n * 0.2), 25)""")
def review_sample(spark, sf):
    """A stratified share for human review: 20 % of each stratum, at least 25."""
    from qamill.operators.ranking import hashed_rank

    ranked = hashed_rank(view(spark, sf, "v_strata"), ["stratum"], "pick", "doc_id")
    return ranked.where(F.col("rank_ix") <= F.greatest(F.ceil(F.col("group_size") * 0.2), F.lit(25))).select(
        "doc_id", "stratum")


@query("pending_documents", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def pending_documents(spark, sf):
    return sinks.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


CACHE_SQL = """
SELECT concat('sys', CAST(user_id % 3 AS STRING)) AS system, concat('q', CAST(user_id AS STRING), event_type) AS question,
       concat('a', CAST(event_id AS STRING)) AS answer, ts, event_type <> 'error' AS success, event_id FROM {events}"""


@query("cache_hits", f"""
WITH e AS ({CACHE_SQL.format(events='events')}),
last AS (SELECT max(ts) AS now FROM e),
best AS (SELECT system, question, max(ts) AS ts FROM e WHERE success GROUP BY system, question),
one AS (SELECT b.system, b.question, b.ts, max(e.answer) AS answer FROM best b JOIN e
        ON e.system = b.system AND e.question = b.question AND e.ts = b.ts AND e.success GROUP BY ALL)
SELECT e.event_id, coalesce(now - one.ts <= INTERVAL 86400 SECOND, false) AS hit,
       CASE WHEN now - one.ts <= INTERVAL 86400 SECOND THEN one.answer END AS cached_answer
FROM e CROSS JOIN last LEFT JOIN one ON e.system = one.system AND e.question = one.question""")
def cache_hits(spark, sf):
    """Every request against the cache of all successes, at the time of the last one."""
    events = spark.sql(CACHE_SQL, events=table(spark, sf, "events"))
    now = events.agg(F.max("ts")).scalar()
    return cache.lookup(events, cache.cacheable(events), now).select("event_id", "hit", "cached_answer")


@query("cache_misses", f"""
WITH e AS ({CACHE_SQL.format(events='events')}),
known AS (SELECT DISTINCT system, question FROM e WHERE success)
SELECT system, count(*) AS n FROM e WHERE NOT EXISTS (
  SELECT 1 FROM known k WHERE k.system = e.system AND k.question = e.question) GROUP BY system""")
def cache_misses(spark, sf):
    events = spark.sql(CACHE_SQL, events=table(spark, sf, "events"))
    found = cache.lookup(events, cache.cacheable(events), F.current_timestamp(), ttl_seconds=0)
    return cache.misses(found).groupBy("system").agg(F.count(F.lit(1)).alias("n"))


@query("latest_per_system", """
SELECT system, file FROM (
  SELECT concat('sys', CAST(user_id % 3 AS STRING)) AS system, concat('f', CAST(event_id AS STRING)) AS file,
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, concat('f', CAST(event_id AS STRING)) DESC) AS rn FROM events) e
WHERE rn = 1""")
def latest_per_system(spark, sf):
    files = table(spark, sf, "events").select(
        F.concat(F.lit("sys"), (F.col("user_id") % 3).cast("string")).alias("system"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"), F.col("ts").alias("mtime"))
    return results.latest_per_system(files)


PAYLOAD_SQL = """
SELECT event_id, event_type <> 'error' AS success, value AS latency,
  CASE event_id % 4 WHEN 0 THEN concat('{{"answer": "a', CAST(event_id AS STRING), '", "contexts": [{{"id": "c1", "text": "t1"}}, {{"id": "c2", "text": "t2"}}]}}')
    WHEN 1 THEN concat('{{"text": "b', CAST(event_id AS STRING), '", "context": {{"id": "c3", "text": "t3"}}}}')
    WHEN 2 THEN concat('{{"result": "r', CAST(event_id AS STRING), '"}}') ELSE props END AS raw
FROM {events}"""


@query("normalise_payload", f"""
SELECT event_id, success, CASE WHEN success THEN latency ELSE 0 END AS latency,
  CASE WHEN success THEN coalesce(json_extract_string(raw, '$.answer'), json_extract_string(raw, '$.text'), json_extract_string(raw, '$.result'), raw) END AS answer,
  CASE WHEN success THEN CAST(coalesce(json_array_length(raw, '$.contexts'), CASE WHEN json_extract(raw, '$.context') IS NOT NULL THEN 1 END) AS INT) END AS n_contexts
FROM ({PAYLOAD_SQL.format(events='events')}) p""")
def normalise_payload(spark, sf):
    raw = spark.sql(PAYLOAD_SQL, events=table(spark, sf, "events"))
    rows = results.normalise_responses(raw)
    return rows.select("event_id", "success", "latency", "answer",
                       F.when(F.col("contexts").isNotNull(), F.size("contexts")).alias("n_contexts"))


@query("corpus_build", rf"""WITH s AS ({_split_sql('PARTITION BY stratum')}),
c AS (SELECT CAST(doc_id AS STRING) AS doc_id, trim(regexp_replace(text, '[{SP}]+', ' ', 'g')) AS text FROM documents)
SELECT split, CAST(sum(ceil(length(text) / 900)) AS BIGINT) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM s JOIN c ON s.doc_id = c.doc_id WHERE length(text) > 0 GROUP BY split""")
def corpus_build(spark, sf):
    """The whole corpus step: clean, chunk, stratified split, members by split."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    chunks, _ = build(docs, CorpusOptions(stratum="lang"))
    step = F.least(F.length("text"), F.lit(900))
    return chunks.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(step).alias("n_chars"))
