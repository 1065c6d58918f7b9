"""Queries of rows, keys, filters and results that the other plans don't show, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions import dates, ids, text, urls
from lexarium.operators import catalog, clean, evaluate, merge, rows, search
from lexarium.plans.preparation import (
    DATASET,
    PAGE_LINES,
    SHELF,
    any_sql,
    catalog_entries,
    dataset,
    docs,
    merge_inputs,
    pages,
    q_alias,
    q_collapse,
    q_host,
    q_normalize,
    q_path,
    q_strip,
    turns,
)
from lexarium.plans.tables import table
from lexarium.sources import readers, snapshots

# ---- filters, keys and shown results --------------------------------------------------------------------------

FILTERS = ("all", "", "BIG DATA", "bd", "news", "src_1", "a$b", "x", "general")


def q_department(x: str) -> str:
    """``ids.department`` with unknown names, as an expression."""
    low = q_strip(f"regexp_replace(strip_accents(lower({x})), '[^[:ascii:]]', '', 'g')")
    tidy = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({low}, '[\s/]+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '[_-]{{2,}}', '_', 'g'), '^[_-]+|[_-]+$', '', 'g')"
    return f"coalesce({q_alias(low)}, {q_alias(tidy)}, nullif({tidy}, ''))"


def q_filter(x: str) -> str:
    own = q_department(x)
    return f"""CASE WHEN coalesce({q_strip(x)}, '') = '' OR lower({q_strip(x)}) = 'all' THEN 'all'
WHEN NOT regexp_matches({q_strip(f'lower({x})')}, '[^a-z0-9 _\\-/]') AND regexp_matches({own}, '^[a-z0-9][a-z0-9_-]{{2,31}}$') THEN {own} END"""


def department_filter(s: SparkSession, d: str) -> DataFrame:
    """Documents by source that pass each filter, valid or not."""
    wanted = s.createDataFrame([(f,) for f in FILTERS], "wanted string")
    own = docs(s, d).groupBy("source").agg(F.count("*").alias("n"))
    return own.join(wanted, search.department_matches(F.col("source"), F.col("wanted"))).select("wanted", "source", "n")


DEPARTMENT_FILTER = f"""WITH w AS (SELECT wanted, {q_filter('wanted')} AS f FROM (SELECT unnest([{', '.join(repr(f) for f in FILTERS)}]) AS wanted)),
o AS (SELECT source, {q_department('source')} AS own, count(*) AS n FROM documents GROUP BY ALL)
SELECT wanted, source, n FROM o JOIN w ON f = 'all' OR own = f"""


def chunk_fields(s: SparkSession, d: str) -> DataFrame:
    """Documents with the fields that a search reads: a third pages with a title, a third PDF chunks, a third tickets."""
    c, k = F.col, F.col("doc_id") % 3
    return docs(s, d).select(
        "doc_id", "text", c("source").alias("department"), F.when(k == 0, "html").when(k == 1, "PDF ").otherwise(F.lit(None)).alias("source_type"),
        F.when(k < 2, F.array_join(F.slice(F.split(text.collapse(c("text")), " "), 1, 3), " ")).alias("page_title"),
        F.concat(F.lit("https://files.example.org/"), c("source"), F.when(k == 1, ".PDF?x").otherwise("")).alias("source"),
        F.when(k == 2, F.concat(F.lit("About "), "lang")).alias("subject"), F.when(k == 2, F.floor(c("doc_id") / 9)).cast("bigint").alias("ticket_id"),
        F.when(k == 0, F.concat(F.lit(" conv_"), F.floor(c("doc_id") / 9).cast("string"))).alias("conversation_id"), c("doc_id").cast("string").alias("chunk_id"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 100).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        (c("doc_id") % 4).cast("int").alias("page_number"), (c("doc_id") % 2).cast("int").alias("chunk_in_page"), F.lit(None).cast("bigint").alias("char_len"),
    )


def q_words(x: str) -> str:
    return f"string_split({q_collapse(x)}, ' ')"


CHUNKS = rf"""chunk AS (SELECT doc_id, text, source AS department, CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'PDF ' END AS source_type,
CASE WHEN doc_id % 3 < 2 THEN array_to_string({q_words('text')}[1:3], ' ') END AS page_title, 'https://files.example.org/' || source || CASE WHEN doc_id % 3 = 1 THEN '.PDF?x' ELSE '' END AS source,
CASE WHEN doc_id % 3 = 2 THEN 'About ' || lang END AS subject, CASE WHEN doc_id % 3 = 2 THEN doc_id // 9 END AS ticket_id, CASE WHEN doc_id % 3 = 0 THEN ' conv_' || (doc_id // 9) END AS conversation_id,
doc_id::VARCHAR AS chunk_id, strftime(DATE '2024-01-01' + (doc_id % 100)::INT, '%Y-%m-%d 00:00:00') AS last_updated, doc_id % 4 AS page_number, doc_id % 2 AS chunk_in_page FROM documents)"""


def group_keys(s, d):
    c = F.col
    rows_ = chunk_fields(s, d).withColumn("source", F.when(c("doc_id") % 2 == 0, c("source")))
    key = search.group_key(c("ticket_id"), c("conversation_id"), c("source"), c("chunk_id"), c("text"))
    return rows_.select("doc_id", key.alias("group_key"), search.result_kind(c("source_type"), c("source")).alias("kind"))


GROUP_KEYS = rf"""WITH {CHUNKS}, c AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN source END AS source) FROM chunk)
SELECT doc_id, coalesce('ticket:' || ticket_id, 'conversation:' || {q_strip('conversation_id')}, 'source:' || source, 'fallback:' || sha1(chunk_id || '|' || substr({q_normalize('text')}, 1, 80))) AS group_key,
CASE WHEN source_type = 'html' THEN 'web' WHEN lower(trim(source_type)) = 'pdf' OR regexp_matches(lower(source), '\.pdf(?:$|[?#])') THEN 'pdf' ELSE 'ticket' END AS kind FROM c"""


def rerank_texts(s, d):
    c = F.col
    # A title that the text lacks, for every second document.
    title = F.when(c("doc_id") % 2 == 0, F.concat(c("page_title"), F.lit(" (manual)"))).otherwise(c("page_title"))
    made = chunk_fields(s, d).select("doc_id", search.rerank_text(c("text"), title, c("source_type")).alias("t"))
    return made.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha1(F.col("t").cast("binary")).alias("text"))


RERANK_TEXTS = f"""WITH {CHUNKS}, t AS (SELECT doc_id, {q_normalize('text')} AS own, lower(trim(source_type)) IN ('html', 'pdf') AS page,
  {q_normalize("coalesce(page_title || CASE WHEN doc_id % 2 = 0 THEN ' (manual)' ELSE '' END, '')")} AS title FROM chunk),
r AS (SELECT doc_id, CASE WHEN page AND title <> '' AND NOT contains(lower(own), lower(title)) THEN CASE WHEN own = '' THEN title ELSE title || chr(10) || chr(10) || own END ELSE own END AS t FROM t)
SELECT doc_id, length(t) AS n, sha1(t) AS text FROM r"""


def exact_containment(s, d):
    """Chunks that hold a token in their text, title, source or subject, by token."""
    c = F.col
    asked = s.createDataFrame([(t,) for t in ("about", "the", "files.example.org", "de", "zzz")], "token string")
    held = chunk_fields(s, d).join(asked, search.holds_token(c("token"), c("text"), c("page_title"), c("source"), c("subject")))
    return held.groupBy("token").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


TOKS = r"regexp_extract_all(strip_accents(lower({0})), '[a-z0-9_./+\\-]+')"
CONTAINMENT = rf"""WITH {CHUNKS}, t AS (SELECT doc_id, list_distinct({TOKS.format("concat_ws(chr(10), text, page_title, source, subject)")}) AS l FROM chunk)
SELECT token, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM t, (SELECT unnest(['about', 'the', 'files.example.org', 'de', 'zzz']) AS token) WHERE list_contains(l, token) GROUP BY ALL"""


def ordered_departments(s, d):
    c = F.col
    given = docs(s, d).select(F.when(c("doc_id") % 5 == 0, "Systems").when(c("doc_id") % 5 == 1, "big data").when(c("doc_id") % 5 == 2, "a$b").otherwise(c("source")).alias("department"))
    return search.ordered_departments(given)


ORDERED = f"""WITH g AS (SELECT DISTINCT {q_filter("CASE doc_id % 5 WHEN 0 THEN 'Systems' WHEN 1 THEN 'big data' WHEN 2 THEN 'a$b' ELSE source END")} AS department FROM documents),
f AS (SELECT department, list_position(['all', {', '.join(repr(x) for x in ids.DEPARTMENTS)}], department) AS p FROM (SELECT department FROM g WHERE department <> 'all' UNION SELECT 'all') WHERE department IS NOT NULL)
SELECT row_number() OVER (ORDER BY coalesce(nullif(p, 0), 99), department) - 1 AS place, department FROM f"""


def shown_results(s, d):
    """Second page of 25 results, by date and then as ranked."""
    c = F.col
    found = chunk_fields(s, d).select(
        "doc_id", F.when(c("doc_id") % 7 > 0, c("doc_id") % 50).alias("rank"), F.when(c("doc_id") % 5 > 0, (c("doc_id") % 11) / 2).alias("rerank_score"),
        F.when(c("doc_id") % 4 > 0, c("last_updated")).alias("last_updated"), c("doc_id").alias("place"),
    )
    return search.pages_of(found, search.result_order(by_date=True), 2, 25).select("doc_id")


SHOWN = f"""WITH {CHUNKS} SELECT doc_id FROM (SELECT doc_id FROM chunk ORDER BY CASE WHEN doc_id % 4 > 0 THEN last_updated END DESC NULLS LAST,
CASE WHEN doc_id % 7 > 0 THEN doc_id % 50 END ASC NULLS LAST, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 11) / 2 END DESC NULLS LAST, doc_id LIMIT 25 OFFSET 25)"""


def distinct_documents(s, d):
    """First document of each key in the order of its lists."""
    none = F.lit(None).cast("string")
    keyed = docs(s, d).select("doc_id", F.col("doc_id").alias("place"), ids.doc_key(F.col("source"), none, none, none, text.normalize(F.col("text"))).alias("key"))
    twice = keyed.unionByName(keyed.withColumn("place", F.col("place") * 2))
    return search.first_seen(twice, ["key"], ["place", "doc_id"]).select("doc_id", "place")


DISTINCT = f"""WITH k AS (SELECT doc_id, doc_id AS place, sha1(source || '|na|na|na|' || substr(sha1({q_normalize('text')}), 1, 16)) AS key FROM documents), t AS (SELECT * FROM k UNION ALL SELECT doc_id, place * 2, key FROM k)
SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, doc_id) AS n FROM t) WHERE n = 1"""

# ---- rows from sources ------------------------------------------------------------------------------------------


def page_inputs(s, d):
    """Documents as PDF pages, some of which lack something."""
    c, k = F.col, F.col("doc_id") % 12
    return docs(s, d).select(
        F.when(k != 0, F.concat(F.lit("https://files.example.org/"), c("source"), F.lit(".pdf"))).alias("source"),
        F.when(k != 1, F.when(c("doc_id") % 2 == 0, "05/02/2024").otherwise("2024-02-05T10:00:00Z")).alias("extracted_at"),
        F.when(k == 2, "Error").when(k == 3, " OK ").when(k == 4, F.lit(None)).otherwise("partial").alias("extraction_status"),
        F.when(k == 5, " \n").when(k == 6, "short").otherwise(c("text")).alias("text"), (c("doc_id") % 11).cast("int").alias("page"),
        F.when(k != 7, (c("doc_id") % 13).cast("int")).alias("total_pages"), c("lang").alias("pdf_relpath"), "doc_id",
    )


def page_reasons(s, d):
    return rows.pdf_rows(page_inputs(s, d), "general")[1]


def pdf_page_rows(s, d):
    made, _ = rows.pdf_rows(page_inputs(s, d), "sistemas", " label ", "job", "2024-03-01")
    message = F.sha1(F.col("messages")[0]["content"].cast("binary")).alias("message")
    return made.select("*", message).drop("messages").withColumn("char_len", F.col("char_len").cast("bigint"))


PAGE_INPUTS = f"""p AS (SELECT doc_id, CASE WHEN doc_id % 12 <> 0 THEN 'https://files.example.org/' || source || '.pdf' END AS source,
CASE WHEN doc_id % 12 <> 1 THEN CASE WHEN doc_id % 2 = 0 THEN '2024-02-05' ELSE '2024-02-05 10:00:00' END END AS extracted_at,
CASE doc_id % 12 WHEN 2 THEN 'error' WHEN 3 THEN 'ok' WHEN 4 THEN NULL ELSE 'partial' END AS status, {q_normalize("CASE doc_id % 12 WHEN 5 THEN ' ' WHEN 6 THEN 'short' ELSE text END")} AS text,
doc_id % 11 AS page, CASE WHEN doc_id % 12 <> 7 THEN doc_id % 13 END AS total, lang AS relpath FROM documents),
r AS (SELECT *, CASE WHEN source IS NULL THEN 'missing source' WHEN extracted_at IS NULL THEN 'missing extracted_at' WHEN status IS NOT NULL AND status NOT IN ('ok', 'partial') THEN 'status=' || status
WHEN text = '' THEN 'empty text' WHEN length(text) < 40 THEN 'text too short (<40)' WHEN page <= 0 THEN 'invalid page number' WHEN coalesce(total, 0) <= 0 THEN 'invalid total pages' END AS skip_reason FROM p)"""
PAGE_REASONS = f"WITH {PAGE_INPUTS} SELECT skip_reason, count(*) AS n FROM r WHERE skip_reason IS NOT NULL GROUP BY ALL"
FIRST_LINE = f"list_filter(list_transform(string_split({{0}}, chr(10)), lambda x: {q_strip('x')}), lambda x: x <> '')[1]"
PDF_ROWS = f"""WITH {PAGE_INPUTS} SELECT source || '#page=' || page AS link, source, source || '#page=' || page AS source_exact, 'pdf' AS source_type, 'sistemas' AS department, 'label' AS ingest_label, 'job' AS ingest_job_id,
'2024-03-01 00:00:00' AS ingested_at, extracted_at AS last_updated, 'doc_' || substr(sha1(source), 1, 12) || '_d' AS conversation_id, 'pdf_' || substr(sha1(source), 1, 12) AS doc_id, page AS page_number, total AS page_total,
'page_' || lpad(page::VARCHAR, 3, '0') AS page_label, 'page=' || page AS page_anchor, {FIRST_LINE.format('text')} AS page_title, length(text) AS char_len, relpath, sha1(text) AS message FROM r WHERE skip_reason IS NULL"""


def paragraphs_input(s, d):
    """Documents whose lines stand as paragraphs, as HTML documents; short ones for some."""
    c, k = F.col, F.col("doc_id") % 10
    body = F.array_join(F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != ""), "\n\n")
    return docs(s, d).select(
        F.when(k != 0, F.concat(F.lit("https://www.example.org/"), c("doc_id").cast("string"))).alias("source"), F.lit("2024-01-01").alias("extracted_at"),
        F.when(k == 1, "error").otherwise("ok").alias("extraction_status"), F.when(k == 2, "").otherwise(body).alias("text"), F.lit("x.html").alias("html_relpath"),
        F.when(k > 5, F.concat(F.lit("Title "), "lang")).alias("title"), "doc_id", "lang",
    )


def html_page_rows(s, d):
    made, _ = rows.html_rows(paragraphs_input(s, d), "general", target=900, most=1200)
    return made.select("link", "doc_id", "page_number", F.col("page_total").cast("int"), "page_label", "page_anchor", F.sha1(F.col("page_title").cast("binary")).alias("title"), F.length(F.col("messages")[0]["content"]).alias("n"))


def html_page_reasons(s, d):
    return rows.html_rows(paragraphs_input(s, d), "general", target=900, most=1200)[1]


def q_packed(x: str, target: int | None, most: int) -> str:
    """Paragraphs ``x`` packed as ``chunk._packed`` does, as a list expression: a fold with the state (pages, open page)."""
    hard = f"list_filter(list_transform(range(0, ceil(length(p.cur) / {most}.0)::BIGINT), lambda i: {q_strip(f'substr(p.cur, i * {most} + 1, {most})')}), lambda z: z <> '')"
    closed = "CASE WHEN a.cur <> '' THEN list_append(a.pages, a.cur) ELSE a.pages END"
    both = "(CASE WHEN a.cur <> '' THEN a.cur || chr(10) || chr(10) || p.cur ELSE p.cur END)"
    fits = f"{{'pages': a.pages, 'cur': {both}}}"
    if target is not None:
        fits = f"CASE WHEN length({both}) >= {target} THEN {{'pages': list_append(a.pages, {both}), 'cur': ''}} ELSE {fits} END"
    step = f"""CASE WHEN length(p.cur) > {most} THEN {{'pages': list_concat({closed}, {hard}), 'cur': ''}} WHEN length({both}) <= {most} THEN {fits} ELSE {{'pages': {closed}, 'cur': p.cur}} END"""
    start = "[{'pages': []::VARCHAR[], 'cur': ''}]"
    return f"list_reduce(list_concat({start}, list_transform({x}, lambda w: {{'pages': []::VARCHAR[], 'cur': w}})), lambda a, p: {step})"


def q_pages(x: str, target: int | None, most: int) -> str:
    packed = q_packed(x, target, most)
    return f"list_transform([{packed}], lambda e: CASE WHEN e.cur <> '' THEN list_append(e.pages, e.cur) ELSE e.pages END)[1]"


PARAS = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {q_strip('x')}), lambda x: x <> '')"
TIDY_PARAS = f"list_filter(list_transform({PARAS}, lambda x: {q_normalize('x')}), lambda x: x <> '')"
HTML_INPUT = f"""h AS (SELECT doc_id, 'https://www.example.org/' || doc_id AS source, CASE WHEN doc_id % 10 > 5 THEN 'Title ' || lang END AS title, {TIDY_PARAS} AS paras,
CASE WHEN doc_id % 10 = 0 THEN 'missing source' WHEN doc_id % 10 = 1 THEN 'status=error' WHEN doc_id % 10 = 2 OR len({TIDY_PARAS}) = 0 THEN 'empty text' END AS skip_reason FROM documents),
g AS (SELECT *, {q_pages('paras', 900, 1200)} AS pages FROM h WHERE skip_reason IS NULL),
u AS (SELECT source, title, len(pages) AS page_total, unnest(pages) AS text, generate_subscripts(pages, 1) AS page_number FROM g)"""
HTML_ROWS = f"""WITH {HTML_INPUT} SELECT source || '#section-' || lpad(page_number::VARCHAR, 3, '0') AS link, 'html_' || substr(sha1(source), 1, 12) AS doc_id, page_number, page_total, 'page_' || lpad(page_number::VARCHAR, 3, '0') AS page_label,
'section-' || lpad(page_number::VARCHAR, 3, '0') AS page_anchor, sha1(coalesce(title, {FIRST_LINE.format('text')})) AS title, length(text) AS n FROM u WHERE length(text) >= 40"""
HTML_REASONS = f"""WITH {HTML_INPUT} SELECT skip_reason, count(*) AS n FROM (SELECT skip_reason FROM h WHERE skip_reason IS NOT NULL UNION ALL SELECT 'page text too short (<40)' FROM u WHERE length(text) < 40) GROUP BY ALL"""


def repo_inputs(s, d):
    c, k = F.col, F.col("doc_id") % 9
    return docs(s, d).select(
        F.when(k != 0, F.concat(F.lit("https://github.com/"), c("source"), F.lit("/r"), c("doc_id").cast("string"))).alias("canonical_url"), F.lit(None).cast("string").alias("source"),
        F.when(k == 1, F.lit(None)).otherwise("2024-01-02 03:04:05").alias("acquired_at"), F.when(k == 2, "").otherwise(F.substring("text", 1, 700)).alias("content"),
        F.when(k != 3, "GitHub").alias("provider"), F.when(k != 4, c("source")).alias("repo_slug"), F.when(k == 5, F.lit(None)).when(k == 6, "Wiki").otherwise("readme").alias("doc_kind"),
        F.when(c("doc_id") % 2 == 0, "Setup").alias("wiki_page_slug"), c("lang").alias("repo_name"), F.concat(F.lit("# "), "lang").alias("page_title"),
    )


def repo_page_rows(s, d):
    made, skipped = rows.repo_rows(repo_inputs(s, d), "general")
    good = made.select("source", "original_url", "acquisition_url", "repo_docs_provider", "repo_docs_kind", "repo_slug", "repo_name", "relpath", "page_label", "page_title", F.lit(None).cast("string").alias("skip_reason"), F.lit(1).cast("bigint").alias("n"))
    return good.unionByName(skipped, allowMissingColumns=True)


REPO_ROWS = f"""WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 9 <> 0 THEN 'https://github.com/' || source || '/r' || doc_id END AS source, source AS slug, {q_normalize("CASE WHEN doc_id % 9 = 2 THEN '' ELSE substr(text, 1, 700) END")} AS text,
CASE doc_id % 9 WHEN 6 THEN 'Wiki' ELSE 'readme' END AS kind FROM documents),
t AS (SELECT *, CASE WHEN source IS NULL THEN 'missing source' WHEN doc_id % 9 = 1 THEN 'missing extracted_at' WHEN text = '' THEN 'empty text' WHEN doc_id % 9 = 3 THEN 'missing provider' WHEN doc_id % 9 = 4 THEN 'missing repo_slug'
WHEN doc_id % 9 = 5 THEN 'missing doc_kind' WHEN length(text) < 40 THEN 'page text too short (<40)' END AS skip_reason FROM r)
SELECT source, source AS original_url, source AS acquisition_url, 'GitHub' AS repo_docs_provider, kind AS repo_docs_kind, slug AS repo_slug, lang AS repo_name,
'repo_docs/github/' || slug || CASE WHEN kind = 'Wiki' THEN CASE WHEN doc_id % 2 = 0 THEN '/wiki/Setup.html' ELSE '/wiki/index.html' END ELSE '/README.md' END AS relpath, 'page_001' AS page_label, '# ' || lang AS page_title, NULL AS skip_reason, 1 AS n FROM t WHERE skip_reason IS NULL
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, skip_reason, count(*) FROM t WHERE skip_reason IS NOT NULL GROUP BY skip_reason"""


def contract_row_builder(s, d):
    """Conversations as rows of several shapes: messages as JSON, question and answer, or a body."""
    c, k = F.col, F.col("conv_id") % 6
    told = turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    listed = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    first = c("m")[0]["text"]
    given = told.select(
        F.when(k == 1, F.concat(F.lit("https://desk.example.org/?id="), c("conv_id").cast("string"))).alias("url"), F.when(k != 0, c("conv_id").cast("string")).alias("ticket_id"),
        F.when(k != 2, "02/01/2024 10:00:00").alias("resolved_at"), F.when(k < 4, listed).alias("messages_json"), F.when(k == 4, first).alias("question"), F.when(k == 4, F.lit("Yes.")).alias("response"),
        F.when(k == 5, first).alias("body"), F.lit(" A subject ").alias("subject"),
    )
    good, skipped = rows.contract_rows(given, "Systems", "https://rt.example.org/?id={ticket_id}")
    texts = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    rows_ = good.select("link", "last_updated", "department", "subject", F.size("messages").cast("bigint").alias("n"), F.sha1(F.array_join(texts, "|").cast("binary")).alias("messages"))
    return rows_.withColumn("skip_reason", F.lit(None).cast("string")).unionByName(skipped.withColumnRenamed("skip_reason", "skip_reason"), allowMissingColumns=True)


CONTRACT_ROWS = f"""WITH m AS (SELECT conv_id, {q_normalize('text')} AS t, turn, CASE role WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'user' END AS role FROM conversations),
g AS (SELECT conv_id, conv_id % 6 AS k, list(role || ':' || t ORDER BY turn) FILTER (t <> '') AS l, arg_min(t, turn) AS first FROM m GROUP BY ALL),
r AS (SELECT *, CASE WHEN k < 4 THEN l WHEN k = 4 THEN ['user:' || first, 'assistant:Yes.'] ELSE ['user:' || first] END AS said, CASE WHEN k = 0 THEN 'missing link' WHEN k = 2 THEN 'missing lastUpdated/last_updated' END AS skip_reason FROM g)
SELECT CASE WHEN k = 1 THEN 'https://desk.example.org/?id=' || conv_id ELSE 'https://rt.example.org/?id=' || conv_id END AS link, '2024-01-02 10:00:00' AS last_updated, 'sistemas' AS department, 'A subject' AS subject, len(said) AS n,
sha1(array_to_string(said, '|')) AS messages, NULL AS skip_reason FROM r WHERE skip_reason IS NULL
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*), NULL, skip_reason FROM r WHERE skip_reason IS NOT NULL GROUP BY skip_reason"""


def repo_urls(s, d):
    c, k = F.col, F.col("doc_id") % 8
    base = F.concat(c("source"), F.lit("/r"), c("doc_id").cast("string"))
    shapes = (
        ("https://github.com/", "/blob/main/README.md"), ("https://www.github.com/", "/wiki"), ("https://github.com/", "/wiki/Home/Sub?a=b#c"), ("https://gitlab.com/grp/", "/-/blob/v1/readme.md"),
        ("https://gitlab.com/", "/-/wikis"), ("https://gitlab.com/grp/sub/", "/-/wikis/x"), ("https://github.com/", "/blob/main/docs/README.md"), ("https://example.org/", "/wiki"),
    )
    url = F.lit(None).cast("string")
    for i, (head, tail) in enumerate(shapes):
        url = F.when(k == i, F.concat(F.lit(head), base, F.lit(tail))).otherwise(url)
    made = docs(s, d).select("doc_id", url.alias("url")).withColumn("x", urls.classify_repo(F.col("url")))
    return made.select("doc_id", "x.provider", "x.doc_kind", "x.repo_slug", "x.canonical_url", "x.acquisition_url", "x.ref", "x.wiki_page_slug", "x.is_wiki_root", urls.repo_problem(F.col("url")).alias("problem"))


REPO_URLS = """WITH b AS (SELECT doc_id, doc_id % 8 AS k, source || '/r' || doc_id AS base FROM documents),
s AS (SELECT doc_id, base, * FROM b JOIN (VALUES (0, 'github', 'readme', 'https://github.com/', '', '/blob/main/README.md', 'https://raw.githubusercontent.com/', '/main/README.md', 'main', NULL, false),
(1, 'github', 'wiki', 'https://www.github.com/', '', '/wiki', 'https://www.github.com/', '/wiki', NULL, NULL, true), (2, 'github', 'wiki', 'https://github.com/', '', '/wiki/Home/Sub', 'https://github.com/', '/wiki/Home/Sub', NULL, 'Home/Sub', false),
(3, 'gitlab', 'readme', 'https://gitlab.com/', 'grp/', '/-/blob/v1/README.md', 'https://gitlab.com/', '/-/raw/v1/README.md', 'v1', NULL, false), (4, 'gitlab', 'wiki', 'https://gitlab.com/', '', '/-/wikis', 'https://gitlab.com/', '/-/wikis', NULL, NULL, true),
(5, 'gitlab', 'wiki', 'https://gitlab.com/', 'grp/sub/', '/-/wikis/x', 'https://gitlab.com/', '/-/wikis/x', NULL, 'x', false)) v(k, provider, doc_kind, host, grp, tail, host2, tail2, ref, wiki, root) USING (k))
SELECT doc_id, provider, doc_kind, grp || base AS repo_slug, host || grp || base || tail AS canonical_url, host2 || grp || base || tail2 AS acquisition_url, ref, wiki AS wiki_page_slug, root AS is_wiki_root, NULL AS problem FROM s
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 6 THEN 'shape' ELSE 'host' END FROM b WHERE k > 5"""


def source_urls(s, d):
    """Urls of mirrored pages below three kinds of base."""
    u = F.col("url")
    rel = F.when(F.col("page_id") % 4 == 0, F.concat(urls.host(u), urls.path(u))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("./"), F.substr(urls.path(u), F.lit(2)))).when(F.col("page_id") % 4 == 2, u).otherwise(urls.path(u))
    base = F.concat(F.lit("https://"), urls.host(u), F.lit("/mirror/"))
    return pages(s, d).select("page_id", rows.html_source_url(base, rel).alias("html_url"), rows.pdf_source_url(base, F.concat(urls.host(u), F.lit("/a.pdf"))).alias("pdf_url"), rows.pdf_source_url(F.concat(base, F.lit("B.PDF")), F.lit("c.pdf")).alias("kept"))


SOURCE_URLS = f"""SELECT page_id, CASE WHEN page_id % 4 = 2 THEN {q_strip('url')} ELSE 'https://' || {q_host('url')} || {q_path('url')} END AS html_url,
'https://' || {q_host('url')} || '/mirror/a.pdf' AS pdf_url, 'https://' || {q_host('url')} || '/mirror/B.PDF' AS kept FROM pages"""


def chunk_ids(s, d):
    c, k = F.col, F.col("doc_id") % 4
    conv = F.when(k == 3, F.concat(F.lit("conv_"), c("doc_id").cast("string"))).otherwise(F.lit("conv_old"))
    own = ids.stable_conversation_id(F.when(k == 3, conv), F.when(k == 2, F.concat(F.lit("https://desk/?id="), c("doc_id").cast("string"))).otherwise(c("source")), c("text"))
    have = F.when(k == 0, F.concat(F.lit("conv_old_chunk_"), c("doc_id").cast("string"))).when(k == 1, F.lit("free")).otherwise(F.lit(""))
    return docs(s, d).select("doc_id", own.alias("conversation_id"), rows.chunk_id(c("text"), own, F.lit("conv_old"), have).alias("chunk_id"))


CHUNK_IDS = f"""WITH c AS (SELECT doc_id, doc_id % 4 AS k, text, CASE doc_id % 4 WHEN 3 THEN 'conv_' || doc_id WHEN 2 THEN 'conv_' || doc_id ELSE 'conv_' || substr(sha1(source || '|' || {q_normalize('text')}), 1, 12) END AS conversation_id FROM documents)
SELECT doc_id, conversation_id, CASE k WHEN 0 THEN conversation_id || '_chunk_' || doc_id WHEN 1 THEN 'free' ELSE conversation_id || '_chunk_' || substr(sha1({q_normalize('text')}), 1, 10) END AS chunk_id FROM c"""


def file_departments(s, d):
    name = F.concat(F.lit("/in/Sistemas-dir/"), F.col("source"), F.when(F.col("doc_id") % 5 == 0, "_Big-Data").when(F.col("doc_id") % 5 == 1, "_comunicacion").when(F.col("doc_id") % 5 == 2, "-GENERAL-sistemas").otherwise(""), F.lit(".jsonl"))
    return docs(s, d).select("doc_id", rows.file_department(name).alias("department"))


FILE_DEPARTMENTS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bigdata' WHEN 1 THEN 'comunicaciones' WHEN 2 THEN 'sistemas' END AS department FROM documents"

# ---- cleaning --------------------------------------------------------------------------------------------------


def noisy_turns(s, d):
    """Turns with quoted replies, form heads, ticket links, separators, comment roles with HTML, closings and signatures."""
    c, k = F.col, F.col("turn") % 6
    body = (
        F.when(k == 1, F.concat(c("text"), F.lit("\nSomebody wrote:\n> quoted text\nFrom: x")))
        .when(k == 2, F.concat(F.lit("head\n* Descripcion: form\nFirst line\n-----\n"), c("text"), F.lit("\n<URL: https://desk.example.org/Ticket/Display.html?id=7 >\nlast")))
        .when(k == 3, F.concat(F.lit("<p>"), c("text"), F.lit("</p><br>Cierro este ticket.<div>Saludos,</div>\n__________\nGracias")))
        .when(k == 4, F.concat(F.lit("Output other This transaction appears to have no content "), c("text")))
        .when(k == 5, F.lit("This transaction appears to have no content."))
        .otherwise(F.concat(c("text"), F.lit("\nAVISO DE CONFIDENCIALIDAD\nStatus: new\nerror _______ in module\n-----Original Message-----")))
    )
    return turns(s, d).select("conv_id", "turn", F.when(k == 3, "comment").otherwise(c("role")).alias("role"), body.alias("text"))


def reply_trims(s, d):
    told = noisy_turns(s, d).where("role <> 'comment'").select("conv_id", "turn", clean.reply_trims(text.normalize(F.col("text"))).alias("t"))
    return told.select("conv_id", "turn", F.sha1(F.col("t.text").cast("binary")).alias("text"), *[F.col(f"t.{n}").cast("bigint").alias(n) for n in ("quote_reply", "create_header", "rt_url_line", "separator_line")])


NOISY = """noisy AS (SELECT conv_id, turn, turn % 6 AS k, CASE WHEN turn % 6 = 3 THEN 'comment' ELSE role END AS role, CASE turn % 6 WHEN 1 THEN text || chr(10) || 'Somebody wrote:' || chr(10) || '> quoted text' || chr(10) || 'From: x'
WHEN 2 THEN 'head' || chr(10) || '* Descripcion: form' || chr(10) || 'First line' || chr(10) || '-----' || chr(10) || text || chr(10) || '<URL: https://desk.example.org/Ticket/Display.html?id=7 >' || chr(10) || 'last'
WHEN 3 THEN '<p>' || text || '</p><br>Cierro este ticket.<div>Saludos,</div>' || chr(10) || '__________' || chr(10) || 'Gracias' WHEN 4 THEN 'Output other This transaction appears to have no content ' || text
WHEN 5 THEN 'This transaction appears to have no content.' ELSE text || chr(10) || 'AVISO DE CONFIDENCIALIDAD' || chr(10) || 'Status: new' || chr(10) || 'error _______ in module' || chr(10) || '-----Original Message-----' END AS text FROM conversations)"""


def q_trims() -> str:
    """CTEs that cut markers one by one: the last has (conv_id, turn, t, quote_reply, create_header, rt_url_line, separator_line, text)."""
    steps = [f"t0 AS (SELECT *, {q_normalize('text')} AS t, 0 AS q, 0 AS c FROM noisy WHERE role <> 'comment')"]
    for i, m in enumerate((*clean.REPLY_MARKERS, *clean.CREATE_MARKERS)):
        mark = "'" + m.replace("\n", "' || chr(10) || '") + "'"
        mark = mark.replace(" || ''", "")
        reply = i < len(clean.REPLY_MARKERS)
        cut = rf"regexp_replace(substr(t, 1, strpos(t, {mark}) - 1), '\n?[^\n]*$', '')" if reply else rf"regexp_replace(string_split(t, {mark})[-1], '^[^\n]*\n?', '')"
        steps.append(f"t{i + 1} AS (SELECT * REPLACE (CASE WHEN contains(t, {mark}) THEN {cut} ELSE t END AS t, {'q' if reply else 'c'} + contains(t, {mark})::INT AS {'q' if reply else 'c'}) FROM t{i})")
    last = len(steps) - 1
    url, line = clean.TICKET_URL_LINE, clean.SEPARATOR_LINE
    steps.append(
        f"trimmed AS (SELECT conv_id, turn, k, role, {q_normalize(f'''regexp_replace(regexp_replace(t, '{url}', '', 'g'), '{line}', '', 'g')''')} AS t, q AS quote_reply, c AS create_header, "
        f"len(regexp_extract_all(t, '{url}')) AS rt_url_line, len(regexp_extract_all(regexp_replace(t, '{url}', '', 'g'), '{line}')) AS separator_line FROM t{last})"
    )
    return ", ".join(steps)


TRIMS = f"WITH {NOISY}, {q_trims()} SELECT conv_id, turn, sha1(t) AS text, quote_reply, create_header, rt_url_line, separator_line FROM trimmed"


def noise_totals(s, d):
    """Totals by conversation over all turns but comments."""
    cleaned = clean.clean_messages(noisy_turns(s, d).where("role <> 'comment'"))
    names = ("noise_candidates", "protected_technical", "dropped_hard_noise", "kept_tagged", "phrase_cleanup_replacements", "phrase_cleanup_removed_all_content", *clean.STATS[13:])
    return clean.conversation_totals(cleaned, "conv_id").select("conv_id", "n_messages", "empty_messages_skipped", "retrieval_fallback_used", *names)


def q_phrases() -> str:
    """CTEs after ``trimmed``: hard phrases cut one by one; these turns have no form's head."""
    steps = [f"p0 AS (SELECT *, {q_collapse('t')} AS p, 0 AS h FROM trimmed)"]
    for i, x in enumerate(clean.HARD_DROPS):
        steps.append(f"p{i + 1} AS (SELECT * REPLACE (regexp_replace(p, '{x}', ' ', 'g') AS p, h + len(regexp_extract_all(p, '{x}')) AS h) FROM p{i})")
    tidy = rf"""regexp_replace(regexp_replace(regexp_replace(p, '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '^\s*[,.;:!?-]+\s*', '')"""
    probe = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<URL:\s*https?://[^>]+>', ' ', 'g'), '(?i)https?://\S+', ' ', 'g'), '\[[A-Z]+\]', ' ', 'g'), '[<>{}()\[\],.:;!?\-_/\\]+', ' ', 'g'))"""
    steps.append(f"tidied AS (SELECT *, {q_normalize(tidy)} AS x FROM p{len(clean.HARD_DROPS)})")
    steps.append(f"phrased AS (SELECT *, h > 0 AND {probe} = '' AS gone, CASE WHEN h > 0 AND {probe} = '' THEN '' ELSE x END AS y FROM tidied)")
    return ", ".join(steps)


def q_lines() -> str:
    reason = lambda x, p: any_sql(x, p)
    hard = reason("l", (clean.SIGNATURE_HINT, clean.SEPARATOR_NOISE, *clean.DROP_LINES))
    return f"""lined AS (SELECT *, list_transform(list_filter(list_transform(string_split(y, chr(10)), lambda z: {q_strip('z')}), lambda z: z <> ''), lambda l: {{'l': l, 'hard': {hard}, 'boiler': {reason('l', clean.BOILERPLATE)}, 'tech': {reason('l', (text.TECHNICAL,))}}}) AS ls FROM phrased),
judged AS (SELECT *, len(list_filter(ls, lambda e: e.hard OR e.boiler)) AS noise_candidates, len(list_filter(ls, lambda e: (e.hard OR e.boiler) AND e.tech)) AS protected_technical, len(list_filter(ls, lambda e: e.hard AND NOT e.tech)) AS dropped_hard_noise,
  len(list_filter(ls, lambda e: e.boiler AND NOT e.hard AND NOT e.tech)) AS kept_tagged, array_to_string(list_transform(list_filter(ls, lambda e: NOT e.hard OR e.tech), lambda e: e.l), chr(10)) AS clean FROM lined),
final AS (SELECT *, CASE WHEN gone THEN '' ELSE t END AS raw, clean = '' AND NOT gone AND t <> '' AS fallback FROM judged)"""


TOTALS = f"""WITH {NOISY}, {q_trims()}, {q_phrases()}, {q_lines()}, f AS (SELECT f.*, {q_normalize('n.text')} = '' AS blank FROM final f JOIN noisy n USING (conv_id, turn)), k AS (SELECT *, NOT blank AND (clean <> '' OR raw <> '') AS kept FROM f)
SELECT conv_id, count_if(kept) AS n_messages, count_if(blank) AS empty_messages_skipped, count_if(kept AND fallback) AS retrieval_fallback_used,
{', '.join(f"sum(CASE WHEN kept THEN {x} ELSE 0 END)::BIGINT AS {n}" for n, x in (('noise_candidates', 'noise_candidates'), ('protected_technical', 'protected_technical'), ('dropped_hard_noise', 'dropped_hard_noise'), ('kept_tagged', 'kept_tagged'), ('phrase_cleanup_replacements', 'h'), ('phrase_cleanup_removed_all_content', 'gone::INT'), (clean.STATS[13], 'quote_reply'), (clean.STATS[14], 'create_header'), (clean.STATS[15], 'rt_url_line'), (clean.STATS[16], 'separator_line')))}
FROM k GROUP BY conv_id"""


def cleaned_turns(s, d):
    """Noisy turns but comments after the whole cleaning."""
    cleaned = clean.clean_messages(noisy_turns(s, d).where("role <> 'comment'"))
    return cleaned.select("conv_id", "turn", F.sha1(F.col("content_retrieval").cast("binary")).alias("retrieval"), F.sha1(F.col("content_raw").cast("binary")).alias("raw"), "retrieval_fallback_used", F.col("noise_stats.dropped_hard_noise").cast("bigint").alias("dropped"))


CLEANED = f"""WITH {NOISY}, {q_trims()}, {q_phrases()}, {q_lines()} SELECT conv_id, turn, sha1(CASE WHEN fallback THEN raw ELSE clean END) AS retrieval, sha1(raw) AS raw, fallback AS retrieval_fallback_used, dropped_hard_noise AS dropped FROM final"""


def comment_cleanup(s, d):
    told = noisy_turns(s, d).where("role = 'comment'").select("conv_id", "turn", clean.comment_cleanup(text.normalize(F.col("text"))).alias("c"))
    return told.select("conv_id", "turn", F.sha1(F.col("c.text").cast("binary")).alias("text"), *[F.col(f"c.{n}").cast("bigint").alias(n) for n in ("html_normalized", "signature_lines", "closures", "removed_all")])


def q_comments() -> str:
    """Comments of ``noisy``: HTML broken into lines, the signature line and the closing cut, trivial lines gone."""
    x = q_normalize("text")
    for p, to in clean.COMMENT_BREAKS:
        if "(?=" in p:
            continue  # no line of these turns has a contact or an inline signature
        shown = to.replace("$1\n$2", "\\1' || chr(10) || '\\2").replace("\n", "' || chr(10) || '") if to != "\n" else "' || chr(10) || '"
        x = f"regexp_replace({x}, '{p}', '{shown}', 'g')"
    tidy = lambda y: q_normalize(rf"regexp_replace(regexp_replace(regexp_replace({y}, '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '^\s*[,.;:!?-]+\s*', '')")
    lines = lambda y: f"list_filter(list_transform(string_split({y}, chr(10)), lambda z: {q_normalize('z')}), lambda z: z <> '')"
    steps = [f"c0 AS (SELECT *, {tidy(x)} AS x FROM noisy WHERE role = 'comment')"]
    steps.append(f"c1 AS (SELECT *, array_to_string(list_filter({lines('x')}, lambda z: NOT {any_sql('z', clean.SIGNATURE_LINES)}), chr(10)) AS y, len(list_filter({lines('x')}, lambda z: {any_sql('z', clean.SIGNATURE_LINES)})) AS signature_lines, 0 AS h FROM c0)")
    for i, p in enumerate(clean.CLOSURES):
        steps.append(f"c{i + 2} AS (SELECT * REPLACE (regexp_replace(y, '{p}', ' ', 'g') AS y, h + len(regexp_extract_all(y, '{p}')) AS h) FROM c{i + 1})")
    n = len(clean.CLOSURES) + 1
    trivial = any_sql("z", clean.TRIVIAL)
    steps.append(f"d AS (SELECT *, {lines(tidy('y'))} AS ls, {tidy('y')} AS z0 FROM c{n})")
    steps.append(f"e AS (SELECT *, CASE WHEN h > 0 THEN {tidy(f'array_to_string(list_filter(ls, lambda z: NOT {trivial}), chr(10))')} ELSE z0 END AS rest, CASE WHEN h > 0 THEN len(list_filter(ls, lambda z: {trivial})) ELSE 0 END AS gone FROM d)")
    return ", ".join(steps)


COMMENTS = rf"""WITH {NOISY}, {q_comments()}, j AS (SELECT *, rest = '' OR (h + gone > 0 AND NOT regexp_matches(rest, '{text.TECHNICAL}') AND len(list_filter(string_split_regex(rest, '\s+'), lambda w: w <> '')) <= 12) AS removed FROM e)
SELECT conv_id, turn, sha1(CASE WHEN removed THEN '' ELSE rest END) AS text, 1 AS html_normalized, signature_lines, h + gone AS closures, removed::BIGINT AS removed_all FROM j"""


def downloader_clean(s, d):
    c, k = F.col, F.col("turn") % 5
    body = (
        F.when(k == 0, F.concat(c("text"), F.lit("\r\nSomebody WROTE:\nquoted")))
        .when(k == 1, F.concat(F.lit("head * DESCRIPCION: \n"), c("text")))
        .when(k == 2, F.concat(F.lit("From: starts it &amp; "), c("text")))
        .when(k == 3, F.concat(c("text"), F.lit("\n<URL: https://desk.example.org/Ticket/Display.html?id="), c("conv_id").cast("string"), F.lit(" >\n\nmore\n---\n")))
        .otherwise(F.lit(" \r\n "))
    )
    made = turns(s, d).select("conv_id", "turn", clean.downloaded(body, c("conv_id"), base="https://desk.example.org").alias("t"))
    return made.select("conv_id", "turn", F.length("t").cast("bigint").alias("n"), F.sha1(F.col("t").cast("binary")).alias("text"))


def q_downloaded() -> str:
    steps = []
    for i, m in enumerate(clean.DOWNLOAD_REPLY):
        mark = ("'" + m.replace("\n", "' || chr(10) || '") + "'").replace(" || ''", "")
        steps.append(f"m{i + 1} AS (SELECT * REPLACE (CASE WHEN strpos(lower(t), {mark}) > 1 THEN substr(t, 1, strpos(lower(t), {mark}) - 1) ELSE t END AS t) FROM m{i})")
    n = len(clean.DOWNLOAD_REPLY)
    for i, m in enumerate(clean.DOWNLOAD_CREATE):
        tail = f"ltrim(substr(t, strpos(lower(t), '{m}') + {len(m)}), chr(10) || ' ')"
        steps.append(f"m{n + i + 1} AS (SELECT * REPLACE (CASE WHEN strpos(lower(t), '{m}') > 0 AND {tail} <> '' THEN {tail} ELSE t END AS t) FROM m{n + i})")
    return ", ".join(steps)


DOWNLOADED = rf"""WITH m0 AS (SELECT conv_id, turn, replace(replace(CASE turn % 5 WHEN 0 THEN text || chr(13) || chr(10) || 'Somebody WROTE:' || chr(10) || 'quoted' WHEN 1 THEN 'head * DESCRIPCION: ' || chr(10) || text WHEN 2 THEN 'From: starts it & ' || text
WHEN 3 THEN text || chr(10) || '<URL: https://desk.example.org/Ticket/Display.html?id=' || conv_id || ' >' || chr(10) || chr(10) || 'more' || chr(10) || '---' || chr(10) ELSE ' ' END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM conversations), {q_downloaded()},
x AS (SELECT conv_id, turn, {q_strip(rf'''regexp_replace(regexp_replace(replace(t, chr(10) || '<URL: https://desk.example.org/Ticket/Display.html?id=' || conv_id || ' >' || chr(10) || chr(10), ''), '{clean.SEPARATOR_LINE}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')''')} AS t FROM m{len(clean.DOWNLOAD_REPLY) + len(clean.DOWNLOAD_CREATE)})
SELECT conv_id, turn, length(t) AS n, sha1(t) AS text FROM x"""

# ---- relevance, roll-ups, catalog, tickets -----------------------------------------------------------------------


def relevance_rows(s, d):
    c, q = F.col, F.col("item_id")
    judged = F.array(
        F.struct(q.cast("string").alias("ticket_id"), F.lit(None).cast("string").alias("conversation_id"), F.lit("3").alias("relevance")),
        F.struct(F.lit("bad").alias("ticket_id"), F.concat(F.lit(" c"), q.cast("string")).alias("conversation_id"), F.lit("-2").alias("relevance")),
        F.struct(F.lit(None).cast("string").alias("ticket_id"), F.lit("cx").alias("conversation_id"), F.lit("high").alias("relevance")),
    )
    return table(s, d, "benchmark").select(
        q.alias("query_id"), q.cast("string").alias("expected_ticket_id"), F.array((q + 1).cast("string"), F.lit("x"), F.lit(None)).alias("expected_ticket_ids"),
        F.lit(" ").alias("expected_conversation_id"), F.when(q % 2 == 0, F.array(F.lit(" a "), F.lit(""))).alias("expected_conversation_ids"), F.when(q % 3 > 0, judged).alias("relevance_judgments"),
    )


def expected_relevance(s, d):
    return evaluate.expected_relevance(relevance_rows(s, d))


RELEVANCE = """r AS (SELECT item_id AS query_id, 'ticket:' || item_id AS identity, 1.0 AS grade FROM benchmark UNION ALL SELECT item_id, 'ticket:' || (item_id + 1), 1.0 FROM benchmark UNION ALL SELECT item_id, 'conversation:a', 1.0 FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT item_id, 'ticket:' || item_id, 3.0 FROM benchmark WHERE item_id % 3 > 0 UNION ALL SELECT item_id, 'conversation:c' || item_id, 0.0 FROM benchmark WHERE item_id % 3 > 0 UNION ALL SELECT item_id, 'conversation:cx', 1.0 FROM benchmark WHERE item_id % 3 > 0),
rel AS (SELECT query_id, identity, max(grade)::DOUBLE AS grade FROM r GROUP BY ALL)"""


def graded_results(s, d):
    c = F.col
    found = docs(s, d).select(
        (c("doc_id") % 40).alias("query_id"), c("doc_id").alias("rank"), F.when(c("doc_id") % 3 == 0, (c("doc_id") % 41).cast("string")).when(c("doc_id") % 3 == 1, "none").alias("ticket_id"),
        F.when(c("doc_id") % 2 == 0, "cx").when(c("doc_id") % 5 == 0, " a ").alias("conversation_id"), c("doc_id").cast("string").alias("chunk_id"),
    )
    told = evaluate.graded_results(found, evaluate.expected_relevance(relevance_rows(s, d)))
    return told.select("query_id", "rank", "grade", evaluate.result_identity(c("ticket_id"), c("conversation_id"), c("chunk_id")).alias("identity"))


GRADED = f"""WITH {RELEVANCE}, f AS (SELECT doc_id % 40 AS query_id, doc_id AS rank, CASE WHEN doc_id % 3 = 0 THEN 'ticket:' || (doc_id % 41) END AS t, CASE WHEN doc_id % 2 = 0 THEN 'conversation:cx' WHEN doc_id % 5 = 0 THEN 'conversation:a' END AS c FROM documents)
SELECT f.query_id, rank, greatest(coalesce(x.grade, 0), coalesce(y.grade, 0)) AS grade, coalesce(t, c, 'chunk:' || rank) AS identity FROM f LEFT JOIN rel x ON x.query_id = f.query_id AND x.identity = t LEFT JOIN rel y ON y.query_id = f.query_id AND y.identity = c"""


def run_totals(s, d):
    """Merge summaries of a run's three files, one of which changes nothing, rolled up."""
    base, new = merge_inputs(s, d)
    made = None
    for rows_ in (new, base.limit(0), new.where("lang = 'es'")):
        one = merge.summary(base, rows_, *merge.merge(base, rows_))
        made = one if made is None else made.unionByName(one)
    return snapshots.run_totals(made).select("files", "no_op_files", "new_rows", "delta_rows", "new_count", "updated_count", "unchanged_count", "out_rows")


TOTAL_RUNS = """WITH n AS (SELECT lang FROM documents WHERE lang <> 'en') SELECT 3 AS files, 1 AS no_op_files, count(*) + count_if(lang = 'es') AS new_rows, count_if(lang <> 'fr') + count_if(lang = 'es') AS delta_rows, 2 * count_if(lang = 'es') AS new_count,
count_if(lang = 'de') AS updated_count, count_if(lang = 'fr') AS unchanged_count, 3 * (SELECT count(*) FROM documents) + 2 * count_if(lang = 'es') AS out_rows FROM n"""


def catalog_buckets(s, d):
    return catalog.overview_buckets(catalog_entries(s, d), 5)


BUCKETS = f"""WITH {DATASET}, w AS (SELECT 'web' AS source_type, coalesce(host, nullif(source, ''), catalog_id) AS label, count(*) AS total_documents, sum(chunk_count)::BIGINT AS total_chunks, count(DISTINCT department) AS department_count, max(last_updated) AS last_updated, NULL AS catalog_id
  FROM entries WHERE source_type = 'web' GROUP BY ALL),
e AS (SELECT *, row_number() OVER (ORDER BY total_documents DESC, total_chunks DESC, lower(label)) AS place FROM (SELECT source_type, label, total_documents, total_chunks, department_count, last_updated, catalog_id FROM w)
  UNION ALL SELECT source_type, coalesce(title, nullif(source, ''), source_type), 1, chunk_count, 1, last_updated, catalog_id, row_number() OVER (PARTITION BY source_type ORDER BY ingested_at DESC NULLS LAST, last_updated DESC NULLS LAST, lower(coalesce(title, source)) DESC, catalog_id DESC)
  FROM entries WHERE source_type IN ('pdf', 'ticket'))
SELECT *, count(*) OVER (PARTITION BY source_type) AS total FROM e QUALIFY place <= 5"""


def catalog_children(s, d):
    return catalog.tree_children(catalog_entries(s, d)).select("grp", "place", "catalog_id", "chunk_count")


CHILDREN = f"""WITH {DATASET} SELECT {SHELF} AS grp, row_number() OVER (PARTITION BY {SHELF} ORDER BY lower(coalesce(title, source)), catalog_id) AS place, catalog_id, chunk_count FROM entries"""


def catalog_lookup(s, d):
    """The entry of the first ticket, looked up by its id, which is derived from its key."""
    known = dataset(s, d).where("source_type = 'ticket'").agg(F.min(F.col("ticket_id").cast("bigint")).alias("t"))
    ident = known.select(F.substring(F.sha1(F.concat(F.lit("ticket|general|ticket:"), F.col("t").cast("string")).cast("binary")), 1, 16)).first()[0]
    return catalog.lookup(catalog_entries(s, d), ident).select("catalog_id", "source", "chunk_count")


LOOKUP = f"WITH {DATASET} SELECT catalog_id, source, chunk_count FROM entries WHERE catalog_id = (SELECT substr(sha1('ticket|general|ticket:' || min(conv_id)), 1, 16) FROM conversations)"


def tickets_with_messages(s, d):
    """Orders as tickets of a time span, lines as their steps, parts as attachments and suppliers as people, by queue."""
    c = F.col
    tickets = table(s, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderdate").alias("LastUpdated"), c("o_orderpriority").alias("Queue"))
    # Whole keys, not a number made of them: that would mix up lines once keys outgrow their digits.
    step = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    lines = table(s, d, "lineitem")
    steps = lines.select(
        step.alias("id"), c("l_orderkey").alias("ObjectId"), F.lit("RT::Ticket").alias("ObjectType"), F.when(c("l_linenumber") % 3 == 0, "Comment").when(c("l_linenumber") % 3 == 1, "Correspond").otherwise("Status").alias("Type"),
        c("l_shipdate").alias("Created"), c("l_suppkey").alias("Creator"),
    )
    files = lines.select(F.lit(0).alias("id"), step.alias("TransactionId"), F.lit("").alias("Content")).union(lines.select(F.lit(1), step, F.concat(F.lit("part "), c("l_partkey").cast("string"))))
    people = table(s, d, "supplier").select(c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 2 == 0, F.concat(c("s_name"), F.lit("@Org.example"))).otherwise(c("s_name")).alias("EmailAddress"))
    made = readers.tickets_with_messages(tickets, steps, files, people, LOW, HIGH, "@org.example", ["1-URGENT", "2-HIGH"])
    said = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return made.select(c("id").alias("ticket"), c("Queue").alias("queue"), c("place").cast("bigint"), F.coalesce(F.array_join(said, "|"), F.lit("")).alias("said"))


LOW, HIGH = "1995-01-01 00:00:00", "1996-01-01 00:00:00"
TICKETS = f"""WITH t AS (SELECT o_orderkey AS ticket, o_orderpriority AS queue, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderdate > TIMESTAMP '{LOW}' AND o_orderdate <= TIMESTAMP '{HIGH}' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
m AS (SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN 'comment' WHEN l_suppkey % 2 = 0 AND s_suppkey IS NOT NULL THEN 'assistant' ELSE 'user' END || ':part ' || l_partkey, '|' ORDER BY l_shipdate, l_linenumber, l_partkey) AS said
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber % 3 < 2 GROUP BY ALL)
SELECT ticket, queue, place, coalesce(said, '') AS said FROM t LEFT JOIN m ON l_orderkey = ticket"""


def extraction_summary(s, d):
    given = docs(s, d).select(F.col("source").alias("department"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("last_updated"))
    return readers.extraction_summary(given)


EXTRACTION = """WITH g AS (SELECT source AS department, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS last_updated FROM documents)
SELECT department, count(*) AS n, max(last_updated) AS newest, (SELECT max(last_updated) FROM g) AS newest_of_all FROM g GROUP BY ALL"""


def migrate_any_column(s, d):
    """Rows of which any of three columns names a host, moved."""
    c = F.col
    given = pages(s, d).select("page_id", c("url").alias("source"), F.when(c("page_id") % 2 == 0, c("url")).alias("canonical_url"), F.lit(None).cast("string").alias("link"), F.lit("sistemas").alias("department"))
    hit = merge.any_host([c("source"), c("canonical_url"), c("link")], "example.org")
    return merge.migrate(given, "department", "general", hit).groupBy("department").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


MIGRATE_ANY = f"""SELECT CASE WHEN {q_host('url')} = 'example.org' OR contains(lower(url), 'example.org') THEN 'general' ELSE 'sistemas' END AS department, count(*) AS n, count_if({q_host('url')} = 'example.org' OR contains(lower(url), 'example.org')) AS changed FROM pages GROUP BY 1"""


def datetime_forms(s, d):
    c, day = F.col, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    k = c("doc_id") % 7
    given = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.date_format(day, "dd/MM/yyyy 10:20:30"))
        .when(k == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:20:30Z"))).when(k == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:20:30+02:00"))).when(k == 5, F.lit(" ")).otherwise(c("source"))
    )
    return docs(s, d).select("doc_id", dates.parse_datetime_like(given).alias("stamp"), dates.iso_utc(dates.parse(given)).alias("iso"))


DATETIMES = """WITH g AS (SELECT doc_id, doc_id % 7 AS k, source, strftime(DATE '2024-01-01' + (doc_id % 300)::INT, '%Y-%m-%d') AS d FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN d || ' 00:00:00' WHEN 1 THEN d WHEN 2 THEN d || ' 10:20:30' WHEN 3 THEN d || ' 10:20:30' WHEN 4 THEN d || ' 08:20:30' WHEN 5 THEN NULL ELSE source END AS stamp,
CASE k WHEN 0 THEN d || 'T00:00:00Z' WHEN 1 THEN d || 'T00:00:00Z' WHEN 2 THEN d || 'T10:20:30Z' WHEN 3 THEN d || 'T10:20:30Z' WHEN 4 THEN d || 'T08:20:30Z' END AS iso FROM g"""


def text_scalars(s, d):
    c = F.col
    made = docs(s, d).select(
        "doc_id", text.normalize_lines(c("text")).alias("lines"), text.truncate(c("text"), 100).alias("short"), text.safe_filename(F.concat(c("source"), F.lit(" "), F.substring("text", 1, 20))).alias("file"),
        text.markdown_title(F.concat(F.lit("\n ## "), c("text"))).alias("title"), text.snippet(c("text"), F.concat(F.lit("About "), c("lang"))).alias("snippet"), text.tidy_phrase(F.concat(F.lit(" ,; a  ,b "), F.substring("text", 1, 50))).alias("phrase"),
    )
    return made.select("doc_id", "file", *[F.sha1(F.col(n).cast("binary")).alias(n) for n in ("lines", "short", "title", "snippet", "phrase")])


SCALARS = rf"""WITH s AS (SELECT doc_id, lang, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {q_strip(r"regexp_replace(x, '[ \t]+', ' ', 'g')")}), lambda x: x <> ''), chr(10)) AS lines, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...[truncated]' ELSE text END AS short,
regexp_replace(source || ' ' || substr(text, 1, 20), '[^A-Za-z0-9._-]', '_', 'g') AS file, {q_strip("regexp_replace(list_filter(list_transform(string_split(chr(10) || ' ## ' || text, chr(10)), lambda x: " + q_strip('x') + "), lambda x: x <> '')[1], '^#+', '')")} AS title,
{q_strip("text")} AS body, {q_normalize(r"regexp_replace(regexp_replace(regexp_replace(' ,; a  ,b ' || substr(text, 1, 50), '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '^\s*[,.;:!?-]+\s*', '')")} AS phrase FROM documents)
SELECT doc_id, file, sha1(lines) AS lines, sha1(short) AS short, sha1(title) AS title, sha1(substr(CASE WHEN length(body) < 80 AND NOT contains(lower(body), lower('About ' || lang)) THEN concat_ws(' - ', 'About ' || lang, body) ELSE body END, 1, 320)) AS snippet, sha1(phrase) AS phrase FROM s"""


def wiki_frontier(s, d):
    """Pages reached from page 0 over links ``page -> 2 page + 1, 2 page + 2``, up to 20, with the step that reached them."""
    links = pages(s, d).select(F.col("page_id").alias("a"), F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("b"))
    links = links.join(pages(s, d).select(F.col("page_id").alias("b")), "b", "left_semi")
    start = s.createDataFrame([(0,)], "page bigint")
    return readers.reached(start, links, 20)


FRONTIER = """WITH RECURSIVE l AS (SELECT page_id AS a, unnest([page_id * 2 + 1, page_id * 2 + 2]) AS b FROM pages), r(page, step) AS (SELECT 0::BIGINT, 0 UNION SELECT b, step + 1 FROM r JOIN l ON a = page WHERE b IN (SELECT page_id FROM pages))
SELECT page, step FROM (SELECT *, row_number() OVER (ORDER BY step, page) AS n FROM r) WHERE n <= 20"""

# ---- forms of queries that other plans define --------------------------------------------------------------------

PARAGRAPHS = f"list_filter(list_transform(string_split({q_normalize('text')}, chr(10) || chr(10)), lambda x: {q_strip('x')}), lambda x: x <> '')"
SPLIT_LONG = f"""WITH p AS (SELECT doc_id, CASE WHEN length({q_normalize('text')}) <= 600 THEN list_filter([{q_normalize('text')}], lambda x: x <> '') ELSE {q_pages(PARAGRAPHS, None, 600)} END AS l FROM documents)
SELECT doc_id, generate_subscripts(l, 1) - 1 AS part, unnest(l) AS piece FROM p"""
SYNTHETIC = f"""WITH {PAGE_LINES}, g AS (SELECT page_id, {q_pages('l', 2200, 2800)} AS pages FROM kept)
SELECT page_id, generate_subscripts(pages, 1) - 1 AS page, unnest(pages) AS text FROM g"""


def q_page_chunks(x: str) -> str:
    """``chunk.page_chunks`` of a list of paragraphs: long ones split, pieces packed, short chunks joined to the one before."""
    pieces = f"flatten(list_transform({x}, lambda w: CASE WHEN length(w) <= 600 THEN [w] ELSE list_filter(list_transform(range(0, ceil(length(w) / 600.0)::BIGINT), lambda i: {q_strip('substr(w, i * 600 + 1, 600)')}), lambda z: z <> '') END))"
    closed = "CASE WHEN a.cur <> '' THEN list_append(a.pages, a.cur) ELSE a.pages END"
    both = "(CASE WHEN a.cur <> '' THEN a.cur || chr(10) || chr(10) || p.cur ELSE p.cur END)"
    close = lambda done, piece: f"CASE WHEN length({piece}) >= 500 THEN {{'pages': list_append({done}, {piece}), 'cur': ''}} ELSE {{'pages': {done}, 'cur': {piece}}} END"
    step = f"CASE WHEN length({both}) <= 600 THEN {close('a.pages', both)} ELSE {close(closed, 'p.cur')} END"
    packed = f"list_reduce(list_concat([{{'pages': []::VARCHAR[], 'cur': ''}}], list_transform({pieces}, lambda w: {{'pages': []::VARCHAR[], 'cur': w}})), lambda a, p: {step})"
    ended = f"list_transform([{packed}], lambda e: CASE WHEN e.cur <> '' THEN list_append(e.pages, e.cur) ELSE e.pages END)[1]"
    joins = "length(b.l[1]) < 120 AND len(a.l) > 0 AND length(a.l[-1]) + 2 + length(b.l[1]) <= 600"
    merged = f"list_reduce(list_concat([{{'l': []::VARCHAR[]}}], list_transform({ended}, lambda w: {{'l': [w]}})), lambda a, b: CASE WHEN {joins} THEN {{'l': list_append(a.l[1:len(a.l) - 1], a.l[-1] || chr(10) || chr(10) || b.l[1])}} ELSE {{'l': list_append(a.l, b.l[1])}} END)"
    return f"({merged}).l"


WHOLE_TEXT = f"list_filter([{q_normalize('array_to_string(l, chr(10))')}], lambda x: x <> '')"
PAGE_CHUNKS = f"""WITH {PAGE_LINES}, g AS (SELECT url AS source, {q_page_chunks(WHOLE_TEXT)} AS c FROM kept JOIN pages USING (page_id)),
u AS (SELECT source, 1 AS page, generate_subscripts(c, 1) - 1 AS chunk_in_page, unnest(c) AS text FROM g)
SELECT *, substr(sha1(source), 1, 12) || '_p001_chunk_' || lpad(chunk_in_page::VARCHAR, 3, '0') AS chunk_id FROM u"""
PLAIN = "noisy AS (SELECT conv_id, turn, turn AS k, role, text FROM conversations)"
FLAGS = f"""list_sort(list_filter([CASE WHEN len(list_filter(ls, lambda e: e.sig)) > 0 THEN 'signature_hint' END, CASE WHEN len(list_filter(ls, lambda e: e.sep)) > 0 THEN 'separator_noise' END, CASE WHEN len(list_filter(ls, lambda e: e.dropped)) > 0 THEN 'legacy_drop_pattern' END,
CASE WHEN len(list_filter(ls, lambda e: e.boiler)) > 0 THEN 'boilerplate' END, CASE WHEN protected_technical > 0 THEN 'protected_technical' END, CASE WHEN h > 0 THEN 'ticket_phrase_hard_drop' END, CASE WHEN gone THEN 'ticket_phrase_removed_all' END,
CASE WHEN quote_reply > 0 THEN 'ticketformater_reply_trim' END, CASE WHEN create_header > 0 THEN 'ticketformater_create_trim' END, CASE WHEN rt_url_line > 0 THEN 'ticketformater_url_trim' END, CASE WHEN separator_line > 0 THEN 'ticketformater_separator_trim' END], lambda x: x IS NOT NULL))"""
LINE_REASONS = f"'sig': {any_sql('l', (clean.SIGNATURE_HINT,))}, 'sep': {any_sql('l', (clean.SEPARATOR_NOISE,))}, 'dropped': {any_sql('l', clean.DROP_LINES)}, 'boiler'"
CLEAN_MESSAGES = f"""WITH {PLAIN}, {q_trims()}, {q_phrases()}, {q_lines().replace("'boiler'", LINE_REASONS)}
SELECT conv_id, turn, role, CASE WHEN fallback THEN raw ELSE clean END AS content_clean, CASE WHEN fallback THEN raw ELSE clean END AS content_retrieval, raw AS content_raw, array_to_string({FLAGS}, ',') AS noise_flags, fallback AS retrieval_fallback_used FROM final"""
PHRASES = f"""WITH trimmed AS (SELECT conv_id, turn, text AS t FROM conversations), {q_phrases()} SELECT conv_id, turn, y AS text, h AS replaced, gone AS removed FROM phrased"""

QUERIES = {
    "department_filter": department_filter, "group_keys": group_keys, "rerank_texts": rerank_texts, "exact_containment": exact_containment, "ordered_departments": ordered_departments,
    "shown_results": shown_results, "distinct_documents": distinct_documents, "page_reasons": page_reasons, "pdf_page_rows": pdf_page_rows, "html_page_rows": html_page_rows,
    "html_page_reasons": html_page_reasons, "repo_page_rows": repo_page_rows, "contract_row_builder": contract_row_builder, "repo_urls": repo_urls, "source_urls": source_urls, "chunk_ids": chunk_ids,
    "file_departments": file_departments, "reply_trims": reply_trims, "noise_totals": noise_totals, "cleaned_turns": cleaned_turns, "comment_cleanup": comment_cleanup, "downloader_clean": downloader_clean,
    "expected_relevance": expected_relevance, "graded_results": graded_results, "run_totals": run_totals, "catalog_buckets": catalog_buckets, "catalog_children": catalog_children, "catalog_lookup": catalog_lookup,
    "tickets_with_messages": tickets_with_messages, "extraction_summary": extraction_summary, "migrate_any_column": migrate_any_column, "datetime_forms": datetime_forms, "text_scalars": text_scalars, "wiki_frontier": wiki_frontier,
}
ORACLE_SQL = {
    "department_filter": DEPARTMENT_FILTER, "group_keys": GROUP_KEYS, "rerank_texts": RERANK_TEXTS, "exact_containment": CONTAINMENT, "ordered_departments": ORDERED, "shown_results": SHOWN,
    "distinct_documents": DISTINCT, "page_reasons": PAGE_REASONS, "pdf_page_rows": PDF_ROWS, "html_page_rows": HTML_ROWS, "html_page_reasons": HTML_REASONS, "repo_page_rows": REPO_ROWS,
    "contract_row_builder": CONTRACT_ROWS, "repo_urls": REPO_URLS, "source_urls": SOURCE_URLS, "chunk_ids": CHUNK_IDS, "file_departments": FILE_DEPARTMENTS, "reply_trims": TRIMS, "noise_totals": TOTALS,
    "cleaned_turns": CLEANED, "comment_cleanup": COMMENTS, "downloader_clean": DOWNLOADED, "expected_relevance": f"WITH {RELEVANCE} SELECT * FROM rel", "graded_results": GRADED, "run_totals": TOTAL_RUNS,
    "catalog_buckets": BUCKETS, "catalog_children": CHILDREN, "catalog_lookup": LOOKUP, "tickets_with_messages": TICKETS, "extraction_summary": EXTRACTION, "migrate_any_column": MIGRATE_ANY, "datetime_forms": DATETIMES,
    "text_scalars": SCALARS, "wiki_frontier": FRONTIER, "split_long": SPLIT_LONG, "synthetic_pages": SYNTHETIC, "page_chunks": PAGE_CHUNKS, "clean_messages": CLEAN_MESSAGES, "phrase_cleanup": PHRASES,
}
