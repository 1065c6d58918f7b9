"""Preparation queries: text, pages, conversations, merges, catalog, profile and incremental loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions import html, ids, text, urls
from lexarium.functions.explode import exploded
from lexarium.operators import catalog, chunk, clean, merge, prepare, profile, retrieve
from lexarium.plans.tables import table
from lexarium.storage import settled, stored
from lexarium.streaming import incremental


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages")


def turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations")


# ---- text ---------------------------------------------------------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def q_strip(x: str) -> str:
    return STRIP.format(x)


def q_normalize(x: str) -> str:
    return q_strip(rf"regexp_replace(regexp_replace(replace({x}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def q_collapse(x: str) -> str:
    return q_strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def lexical_fold(s, d):
    return docs(s, d).select("doc_id", F.sha1(text.fold(F.col("text")).cast("binary")).alias("folded"), F.length(text.collapse(F.col("text"))).cast("bigint").alias("n"))


def hard_split(s, d):
    whole = exploded(docs(s, d), chunk.hard_split(F.col("text"), 600), "piece", "doc_id", position="part")
    return whole.select("doc_id", F.col("part").cast("bigint"), F.length("piece").cast("bigint").alias("n"), F.sha1(F.col("piece").cast("binary")).alias("piece"))


def split_long(s, d):
    return exploded(docs(s, d), chunk.split_long(F.col("text"), 600), "piece", "doc_id", position="part")


HARD = rf"""WITH p AS (SELECT doc_id, i, {q_strip('substr(text, i * 600 + 1, 600)')} AS piece
FROM documents, LATERAL (SELECT unnest(range(0, greatest(1, ceil(length(text) / 600.0)::BIGINT))) AS i))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part, length(piece) AS n, sha1(piece) AS piece FROM p WHERE piece <> ''"""


def noise_flags(s, d):
    lines = docs(s, d).select("doc_id", F.explode(clean.noise_lines(F.col("text"))).alias("x"))
    reasons = ("signature_hint", "separator_noise", "legacy_drop_pattern", "boilerplate", "technical")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), *[F.count_if(F.col("x")[r]).alias(r) for r in reasons])


def any_sql(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


NOISE = rf"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {q_strip('x')}), lambda x: x <> '')) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count_if({any_sql('line', (clean.SIGNATURE_HINT,))}) AS signature_hint, count_if({any_sql('line', (clean.SEPARATOR_NOISE,))}) AS separator_noise,
count_if({any_sql('line', clean.DROP_LINES)}) AS legacy_drop_pattern, count_if({any_sql('line', clean.BOILERPLATE)}) AS boilerplate, count_if({any_sql('line', (text.TECHNICAL,))}) AS technical FROM l GROUP BY ALL"""


def clean_lines(s, d):
    return docs(s, d).select("doc_id", clean.drop_noise_lines(clean.noise_lines(F.col("text")), clean.Cleaning(drop_boilerplate=True)).alias("clean")).select(
        "doc_id", F.length("clean").cast("bigint").alias("n"), F.sha1(F.col("clean").cast("binary")).alias("clean")
    )


HARD_OR_BOILER = f"({any_sql('x', (clean.SIGNATURE_HINT, clean.SEPARATOR_NOISE, *clean.DROP_LINES, *clean.BOILERPLATE))})"
CLEAN = rf"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {q_strip('x')}),
lambda x: x <> '' AND (NOT {HARD_OR_BOILER} OR {any_sql('x', (text.TECHNICAL,))})), chr(10)) AS clean FROM documents)
SELECT doc_id, length(clean) AS n, sha1(clean) AS clean FROM l"""


def clean_messages(s, d):
    made = clean.clean_messages(turns(s, d)).withColumn("noise_flags", F.array_join("noise_flags", ","))
    return made.select("conv_id", "turn", "role", *[c for c in clean.CLEANED if c != "noise_stats"])


def phrase_cleanup(s, d):
    return turns(s, d).select("conv_id", "turn", clean.clean_phrases(F.col("text")).alias("p")).select("conv_id", "turn", "p.*")


# ---- pages --------------------------------------------------------------------------------------------------


def q_html(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<!--.*?-->', ' ', 'g')"
    x = rf"(CASE WHEN regexp_matches({x}, '(?is)<body\b[^>]*>(.*)</body>') THEN regexp_extract({x}, '(?is)<body\b[^>]*>(.*)</body>', 1) ELSE {x} END)"
    for p in html.CUTS:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    for p, to in html.BREAKS:
        x = f"regexp_replace({x}, '{p}', {' || '.join(['chr(10)'] * to.count(chr(10))) or repr(to)}, 'g')"
    return q_page_normalize(q_unescape(x))


def q_unescape(x: str) -> str:
    for name, char in html.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def q_page_normalize(x: str) -> str:
    return q_normalize(f"replace({x}, chr(160), ' ')")


MENU = f"(x IN ({', '.join(repr(m) for m in html.MENU_LINES)}) OR {any_sql('x', html.MENU_PATTERNS)})"
PAGE_LINES = rf"""flat AS (SELECT page_id, {q_html('html')} AS flat FROM pages),
sifted AS (SELECT page_id, list_filter(list_transform(string_split(flat, chr(10)), lambda x: {q_page_normalize('x')}), lambda x: length(x) >= 2 AND NOT {MENU}) AS l FROM flat),
kept AS (SELECT page_id, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS l FROM sifted)"""
TITLE = f"nullif({q_page_normalize(q_unescape(r'''regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?is)<[^>]+>', ' ', 'g')'''))}, '')"


def html_lines(s, d):
    return exploded(pages(s, d), html.lines(F.col("html")), "line", "page_id", position="n").select("page_id", F.col("n").cast("bigint"), "line")


def html_text(s, d):
    t = pages(s, d).select("page_id", html.text(F.col("html")).alias("text"))
    return t.select("page_id", F.length("text").cast("bigint").alias("n"), F.sha1(F.col("text").cast("binary")).alias("text"))


def page_chunks(s, d):
    rows = pages(s, d).select(F.col("url").alias("source"), F.lit(1).alias("page"), html.text(F.col("html")).alias("text"))
    return chunk.explode_page_chunks(rows)


def synthetic_pages(s, d):
    # Lines of a page stand as paragraphs, so that there is something to pack.
    body = F.array_join(html.lines(F.col("html")), "\n\n")
    return exploded(pages(s, d), chunk.synthetic_pages(body), "text", "page_id", position="page")


def page_acceptance(s, d):
    rows = pages(s, d).select("page_id", F.col("url").alias("source"), html.text(F.col("html")).alias("text"))
    reason = prepare.page_skip_reason(F.col("source"), F.lit("2024-01-01"), F.lit("ok"), F.col("text"), F.lit(1), F.lit(1), 400)
    return prepare.skip_histogram(rows.select("page_id", reason.alias("skip_reason")))


ACCEPT = f"""WITH {PAGE_LINES}, t AS (SELECT page_id, {q_normalize("array_to_string(l, chr(10))")} AS text FROM kept)
SELECT skip_reason, count(*) AS n FROM (SELECT CASE WHEN coalesce({q_strip('url')}, '') = '' THEN 'missing source' WHEN {q_strip('text')} = '' THEN 'empty text' WHEN length(text) < 400 THEN 'text too short (<400)' END AS skip_reason
FROM t JOIN pages USING (page_id)) WHERE skip_reason IS NOT NULL GROUP BY ALL"""


def boost_scoring(s, d):
    rows = pages(s, d).select("page_id", html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("text"))
    rows = rows.withColumn("q", F.slice(text.tokens(F.col("title")), 1, 2))
    boost = retrieve.short_query_boost(F.col("q"), F.col("title"), F.col("text"), F.lit("html"), F.lit(1), F.lit(0))
    return rows.where(F.size("q") > 0).select("page_id", boost.alias("boost"), retrieve.low_information(F.col("text"), F.lit("html")).alias("low"))


TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[a-z0-9_./+\\-]+')"
BOOST = rf"""WITH {PAGE_LINES}, t AS (SELECT page_id, {q_normalize("array_to_string(l, chr(10))")} AS text, {TITLE} AS title FROM kept JOIN pages USING (page_id)),
q AS (SELECT *, {TOKENS.format('title')}[1:2] AS q, (text = '' OR length(text) < 80 OR len({TOKENS.format('text')}) < 6) AS low FROM t)
SELECT page_id, (CASE WHEN low THEN -6.0 ELSE (CASE WHEN len(list_filter(q, lambda w: NOT contains(strip_accents(lower({q_normalize('title')})), w))) = 0 THEN 1.5 ELSE 0 END)
  + 1.0 + (CASE WHEN length(text) >= 160 THEN 0.5 ELSE 0 END) END)::DOUBLE AS boost, low FROM q WHERE len(q) > 0"""

URL_PARTS = "(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def q_host(u: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_extract({u}, '{URL_PARTS}', 2), '^.*@', ''), ':\d*$', ''))"


def q_path(u: str) -> str:
    return f"regexp_extract({u}, '{URL_PARTS}', 3)"


def url_canonicalize(s, d):
    u = F.col("url")
    return pages(s, d).select("page_id", urls.canonicalize(u).alias("canonical"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.host_label(urls.host(u)).alias("label"))


CANON = rf"""SELECT page_id, CASE WHEN regexp_matches(url, '{URL_PARTS}') THEN lower(regexp_extract(url, '{URL_PARTS}', 1)) || '://' || lower(regexp_extract(url, '{URL_PARTS}', 2)) || regexp_replace({q_path('url')}, '/+$', '') END AS canonical,
{q_host('url')} AS host, {q_path('url')} AS path,
array_to_string(list_transform(list_filter(string_split_regex(translate(split_part(regexp_replace({q_host('url')}, '^www\.', ''), '.', 1), '-_', '  '), ' +'), lambda x: x <> ''),
  lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS label FROM pages"""


def url_scope(s, d):
    seed = F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/en/index.html"))
    return pages(s, d).select("page_id", urls.in_scope(F.col("url"), seed).alias("in_scope"), urls.forbidden_host(urls.host(F.col("url"))).alias("forbidden"))


SCOPE = f"SELECT page_id, starts_with({q_path('url')}, '/en/') AS in_scope, ({q_host('url')} = '' OR regexp_matches({q_host('url')}, '{urls.PRIVATE}')) AS forbidden FROM pages"

# ---- keys and departments -------------------------------------------------------------------------------------

NAMES = ("BIG DATA", "bd", "Data Science Team", "Platform/Ops", "Aplicación", "x", "a$b", "Systems", "--general--")


def department_normalize(s, d):
    given = docs(s, d).select(F.col("source").alias("raw")).distinct()
    given = given.union(table(s, d, "part").select("p_brand").distinct()).union(s.createDataFrame([(n,) for n in NAMES], "raw string"))
    raw = F.col("raw")
    return given.select("raw", ids.department(raw, True).alias("department"), ids.department(raw).alias("known"), ids.valid_department(raw).alias("valid"))


def q_alias(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(repr(m) for m in many)}) THEN '{name}'" for name, many in ids.ALIASES) + " END"


DEPARTMENT = rf"""WITH g AS (SELECT DISTINCT source AS raw FROM documents UNION ALL (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT unnest([{', '.join(repr(n) for n in NAMES)}])),
a AS (SELECT raw, {q_strip("regexp_replace(strip_accents(lower(raw)), '[^[:ascii:]]', '', 'g')")} AS low FROM g),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, '[\s/]+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '[_-]{{2,}}', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') AS c FROM a),
e AS (SELECT *, coalesce({q_alias('low')}, {q_alias('c')}, nullif(c, '')) AS department FROM b)
SELECT raw, department, CASE WHEN department IN ({', '.join(repr(x) for x in ids.DEPARTMENTS)}) THEN department END AS known,
CASE WHEN NOT regexp_matches({q_strip('lower(raw)')}, '[^a-z0-9 _\-/]') AND regexp_matches(department, '^[a-z0-9][a-z0-9_-]{{2,31}}$') THEN department END AS valid FROM e"""


def doc_keys(s, d):
    none = F.lit(None).cast("string")
    c = F.col
    return docs(s, d).select("doc_id", ids.doc_key(c("source"), none, none, c("doc_id").cast("string"), c("text")).alias("doc_key"))


def merge_keys(s, d):
    none = F.lit(None).cast("string")
    conv = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    a = docs(s, d).select(F.concat(F.lit("d"), "doc_id").alias("row"), ids.merge_key(F.col("source"), none, none, none, F.col("text")).alias("merge_key"), ids.ticket_group(F.lit("html"), none, F.col("source"), none).alias("grp"))
    b = turns(s, d).select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("row"), ids.merge_key(none, none, F.col("conv_id"), conv, F.col("text")).alias("merge_key"), ids.ticket_group(F.lit("ticket"), none, none, conv).alias("grp")
    )
    return a.unionByName(b)


MERGE_KEYS = f"""SELECT 'd' || doc_id AS row, source || '|' || sha1({q_collapse('text')}) AS merge_key, NULL AS grp FROM documents
UNION ALL SELECT 'c-' || conv_id || '-' || turn, conv_id || '|conv_' || conv_id || '|' || sha1({q_collapse('text')}), 'ticket:' || conv_id FROM conversations"""

# ---- conversations --------------------------------------------------------------------------------------------


def conversation_turns(s, d):
    from pyspark.sql import Window

    label = F.when(text.strip(F.lower(F.coalesce("role", F.lit("user")))) == "user", "User").otherwise("Assistant")
    rows = turns(s, d).where(text.strip(F.coalesce("text", F.lit(""))) != "").select("conv_id", "turn", F.concat(label, F.lit(": "), text.strip(F.col("text"))).alias("line"))
    before = F.lag("line").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("before", before).where("before is null or before <> line").drop("before")


TURNS = f"""SELECT conv_id, turn, line FROM (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (
SELECT conv_id, turn, (CASE WHEN {q_strip("lower(coalesce(role, 'user'))")} = 'user' THEN 'User' ELSE 'Assistant' END) || ': ' || {q_strip('text')} AS line FROM conversations WHERE {q_strip("coalesce(text, '')")} <> ''))
WHERE before IS NULL OR before <> line"""


def conversation_chunks(s, d):
    cleaned = clean.clean_messages(turns(s, d))
    return chunk.chunk_conversations(cleaned.select("conv_id", "turn", "role", F.col("content_retrieval").alias("retrieval"), F.col("content_raw").alias("raw")))


def contract_validation(s, d):
    role = F.when(F.col("role") != "system", F.col("role"))
    rows = turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    messages = F.when(F.col("conv_id") % 7 == 0, F.lit(None)).when(F.col("conv_id") % 7 == 1, F.slice(messages, 1, 0)).otherwise(messages)
    link = F.when(F.size("m") > 3, F.concat(F.lit("https://desk.example.org/?id="), F.col("conv_id").cast("string")))
    errors = prepare.contract_errors(link, F.when(F.col("conv_id") % 5 == 0, " ").otherwise("2024-01-01"), messages, F.lit(None).cast("string"))
    return rows.select("conv_id", F.array_join(errors, "; ").alias("errors"), F.size(errors).cast("bigint").alias("n"))


CONTRACT = f"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role = 'system' AND {q_strip("coalesce(text, '')")} <> '' AS bad, {q_strip("coalesce(text, '')")} <> '' AS filled FROM conversations),
g AS (SELECT conv_id, conv_id % 7 AS k, count(*) AS n, bool_or(filled) AS filled, list('messages[' || i || '].role missing/empty' ORDER BY i) FILTER (bad) AS bad FROM m GROUP BY ALL),
e AS (SELECT conv_id, list_concat(CASE WHEN n > 3 THEN [] ELSE ['missing/empty ''link'''] END, CASE WHEN conv_id % 5 = 0 THEN ['missing ''lastUpdated'' or ''last_updated'''] ELSE [] END,
  CASE WHEN k = 0 THEN ['''messages'' must be a list'] WHEN k = 1 THEN [] ELSE coalesce(bad, []) END,
  CASE WHEN k = 1 OR (k > 1 AND NOT filled) THEN ['row must contain at least one non-empty messages[].content or a non-empty ''subject'''] ELSE [] END) AS l FROM g)
SELECT conv_id, array_to_string(l, '; ') AS errors, len(l) AS n FROM e"""


def profile_conversations(s, d):
    return profile.profile_messages(turns(s, d))


def q_phones(x: str) -> str:
    """Number of phone numbers: DuckDB's patterns take the characters around a number, so those that two may share are doubled first."""
    apart = rf"regexp_replace(regexp_replace({x}, '([^\w\s().+-])', '\1\1', 'g'), '([\s().-])\+', '\1\1+', 'g')"
    return rf"sum(len(regexp_extract_all({apart}, '(?:^|[^\w])\+?\d[\d\s().-]{{6,}}\d(?:$|[^\w])')))::BIGINT"


def q_pct(name: str, rel: str, col: str) -> str:
    shares = (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("max", 1.0))
    return ", ".join(f"(SELECT coalesce(list_sort(list({col}))[floor((count({col}) - 1) * {p})::BIGINT + 1], 0) FROM {rel}) AS {name}_{n}" for n, p in shares)


PROFILE = rf"""WITH m AS (SELECT *, length(text) AS chars FROM conversations), c AS (SELECT conv_id, count(*) AS n, (sum(chars) + count(*) - 1)::BIGINT AS chars FROM m GROUP BY ALL)
SELECT count(*) AS messages, count(DISTINCT conv_id) AS conversations, count_if(regexp_matches(text, '{text.SIGNATURE}')) AS signature_messages, count_if(regexp_matches(text, '{text.URL}')) AS url_messages,
sum(len(regexp_extract_all(text, '{text.EMAIL}')))::BIGINT AS emails, {q_phones('text')} AS phones, count_if(regexp_matches(text, '{text.QUOTE}')) AS quote_messages, round(count(*) / count(DISTINCT conv_id), 3) AS messages_per_conversation,
{q_pct('conv_messages', 'c', 'n')}, {q_pct('message_chars', 'm', 'chars')}, {q_pct('conv_chars', 'c', 'chars')} FROM m"""


def chunk_quality_report(s, d):
    return profile.chunk_quality(docs(s, d), "source")


QUALITY = rf"""WITH m AS (SELECT *, length(text) AS chars FROM documents), g AS (SELECT source, count(*) AS n FROM m GROUP BY ALL)
SELECT count(*) AS total_chunks, round(count_if(chars BETWEEN 400 AND 600) / count(*), 4) AS in_range_pct, round(count_if(chars < 120) / count(*), 4) AS tiny_chunk_pct,
sum(len(regexp_extract_all(text, '{text.EMAIL}')))::BIGINT AS email_leak, {q_phones('text')} AS phone_leak, count_if(regexp_matches(text, '{text.SIGNATURE}')) AS signature_hits,
round(count_if(chars BETWEEN 400 AND 600) / count(*), 4) >= 0.9 AND round(count_if(chars < 120) / count(*), 4) <= 0.02 AS all_pass, (SELECT count(*) FROM g) AS unique_groups,
{q_pct('len', 'm', 'chars')}, {q_pct('per_group', 'g', 'n')} FROM m"""

# ---- dedupe, merge, purge -------------------------------------------------------------------------------------


def dedupe_longest(s, d):
    return merge.keep_longest(docs(s, d), ["source", "lang"], F.length("text"), "doc_id").select("source", "lang", "doc_id", F.length("text").cast("bigint").alias("n"))


def chunk_dedupe(s, d):
    rows = docs(s, d).select("doc_id", F.sha1(text.normalize(F.col("text")).cast("binary")).alias("h"))
    return rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def merge_inputs(s, d):
    """Base: all documents. New: those not in English; German ones revised, Spanish ones under a new key."""
    base = docs(s, d).select(F.concat_ws("|", "source", F.col("doc_id").cast("string")).alias("merge_key"), "doc_id", "lang", "source", "text", F.lit("a").alias("ingest_job_id"))
    new = base.where("lang <> 'en'").withColumn("ingest_job_id", F.lit("b"))
    new = new.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" (rev)"))).otherwise(F.col("text")))
    return base, new.withColumn("merge_key", F.when(F.col("lang") == "es", F.concat("merge_key", F.lit("|new"))).otherwise(F.col("merge_key")))


def merge_delta(s, d):
    _, told = merge.merge(*merge_inputs(s, d))
    return merge.delta(told).select("merge_key", "doc_id", "change")


def merge_all(s, d):
    merged, _ = merge.merge(*merge_inputs(s, d))
    return merged.select("merge_key", F.length("text").cast("bigint").alias("n"), "ingest_job_id")


def merge_summary(s, d):
    base, new = merge_inputs(s, d)
    return merge.summary(base, new, *merge.merge(base, new))


def group_replace(s, d):
    """Groups are sources: a source that has documents not in English is replaced as a whole."""
    base, new = merge_inputs(s, d)
    return merge.summary(base, new, *merge.merge(base, new, group="source"), group="source")


KEYS = "b AS (SELECT source || '|' || doc_id AS k, * FROM documents), n AS (SELECT CASE WHEN lang = 'es' THEN k || '|new' ELSE k END AS k, doc_id, lang, source, CASE WHEN lang = 'de' THEN text || ' (rev)' ELSE text END AS text FROM b WHERE lang <> 'en')"
KINDS = "sum((lang <> 'fr')::INT)::BIGINT AS delta_rows, sum((lang = 'es')::INT)::BIGINT AS new_count, sum((lang = 'de')::INT)::BIGINT AS updated_count, sum((lang = 'fr')::INT)::BIGINT AS unchanged_count"


def purge_department(s, d):
    return merge.purge(docs(s, d), F.col("lang") == "de")[1]


def migrate_department(s, d):
    hit = F.endswith(urls.host(F.col("url")), F.lit(".example.org"))
    moved = merge.migrate(pages(s, d).withColumn("department", F.regexp_extract("url", r"://[^/]*/(\w\w)/", 1)), "department", "general", hit)
    return moved.groupBy("department").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


def ticket_messages_join(s, d):
    """Orders with their lines' part names as ordered messages; orders without lines stay."""
    lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    told = prepare.ordered_messages(lines.withColumn("m", F.concat_ws(" / ", "p_name", "s_name")), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("m"))
    return table(s, d, "orders").join(told, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderpriority", "messages_json", F.coalesce("n", F.lit(0)).alias("n"))


JOIN = """WITH l AS (SELECT l_orderkey, count(*) AS n, to_json(list(concat_ws(' / ', p_name, s_name) ORDER BY l_linenumber, l_partkey, l_suppkey))::VARCHAR AS messages_json FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT o_orderkey, o_orderpriority, messages_json, coalesce(n, 0) AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey"""

# ---- catalog --------------------------------------------------------------------------------------------------


def dataset(s, d):
    """Documents as PDF chunks by source, pages as web documents, turns as ticket chunks."""
    none = F.lit(None).cast("string")
    c = F.col
    a = docs(s, d).select(
        F.lit("pdf").alias("source_type"), c("lang").alias("department"), none.alias("ticket_id"), c("source").alias("doc_id"), none.alias("conversation_id"), c("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("https://files.example.org/"), "source", F.lit(".pdf")).alias("source"), none.alias("subject"), c("source").alias("page_title"), F.lit("2024-01-01 00:00:00").alias("last_updated"),
        F.lit("job-a").alias("ingest_job_id"), F.lit("2024-02-01 00:00:00").alias("ingested_at"), "text", c("doc_id").cast("bigint").alias("position"),
    )
    b = pages(s, d).select(
        F.lit("html").alias("source_type"), F.regexp_extract("url", r"://[^/]*/(\w\w)/", 1).alias("department"), none.alias("ticket_id"), none.alias("doc_id"), none.alias("conversation_id"), c("page_id").cast("string").alias("chunk_id"),
        c("url").alias("source"), none.alias("subject"), html.title(c("html")).alias("page_title"), F.concat(F.lit("2024-03-01 00:00:"), F.lpad((c("page_id") % 60).cast("string"), 2, "0")).alias("last_updated"),
        F.lit("job-b").alias("ingest_job_id"), F.lit("2024-03-02 00:00:00").alias("ingested_at"), F.lit("").alias("text"), (c("page_id") + 10**12).alias("position"),
    )
    t = turns(s, d).select(
        F.lit("ticket").alias("source_type"), F.lit("general").alias("department"), c("conv_id").cast("string").alias("ticket_id"), none.alias("doc_id"), none.alias("conversation_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"),
        F.concat(F.lit("https://desk.example.org/?id="), c("conv_id").cast("string")).alias("source"), none.alias("subject"), none.alias("page_title"), F.concat(F.lit("2024-01-02 00:00:"), F.lpad(c("turn").cast("string"), 2, "0")).alias("last_updated"),
        none.alias("ingest_job_id"), none.alias("ingested_at"), "text", (c("conv_id") * 10_000 + c("turn") + 2 * 10**12).alias("position"),
    )
    return prepare.union_sources(a, b, t)


DATASET = rf"""data AS (SELECT 'pdf' AS type, lang AS department, 'doc:' || source AS identity, 'https://files.example.org/' || source || '.pdf' AS source, source AS title, 0 AS r, '2024-01-01 00:00:00' AS last_updated, 'job-a' AS job, '2024-02-01 00:00:00' AS ingested_at, doc_id AS position FROM documents
UNION ALL SELECT 'web', coalesce(nullif(regexp_extract(url, '://[^/]*/(\w\w)/', 1), ''), 'unknown'), 'source:' || url, url, coalesce({TITLE}, url), CASE WHEN {TITLE} IS NULL THEN 2 ELSE 0 END, '2024-03-01 00:00:' || lpad((page_id % 60)::VARCHAR, 2, '0'), 'job-b', '2024-03-02 00:00:00', page_id + 1000000000000 FROM pages
UNION ALL SELECT 'ticket', 'general', 'ticket:' || conv_id, 'https://desk.example.org/?id=' || conv_id, 'https://desk.example.org/?id=' || conv_id, 2, '2024-01-02 00:00:' || lpad(turn::VARCHAR, 2, '0'), NULL, NULL, conv_id * 10000 + turn + 2000000000000 FROM conversations),
entries AS (SELECT substr(sha1(type || '|' || department || '|' || identity), 1, 16) AS catalog_id, type AS source_type, department, arg_min(source, position) AS source, nullif({q_host('arg_min(source, position)')}, '') AS host, arg_min(title, r * 1e13 + position) AS title,
  count(*) AS chunk_count, max(last_updated) AS last_updated, max(job) AS ingest_job_id, max(ingested_at) AS ingested_at FROM data GROUP BY type, department, identity)"""
SHELF = "CASE WHEN source_type = 'ticket' THEN 'tickets' ELSE coalesce(regexp_replace(host, '^www\\.', ''), nullif(source, ''), catalog_id) END"


def catalog_entries(s, d):
    return catalog.entries(dataset(s, d))


def catalog_filter_page(s, d):
    return catalog.page(catalog.matching(catalog_entries(s, d), kind="web", q="example.org"), 2, 25).select("catalog_id", "department", "title", "total", "has_more")


def catalog_page_after(s, d):
    """The 25 entries that follow the first web entry's place in the listing."""
    return catalog.page_after(catalog_entries(s, d), 25, ("web", "", "", "")).select("catalog_id", "source_type", "department", "title")


def catalog_changes(s, d):
    """What changes in the dataset: toxic documents go, those of quality 0 get a later chunk without a job, benchmark items come in as a file."""
    told = table(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = dataset(s, d).where("source_type = 'pdf'").join(told, F.col("position") == told["doc_id"], "left").drop(told["doc_id"])
    names = dataset(s, d).columns
    removed = known.where("toxic = 1").select(names)
    new = {"last_updated": F.lit("2024-05-01T02:00:00+02:00"), "ingest_job_id": F.lit(None).cast("string"), "ingested_at": F.lit("2024-05-02T00:00:00Z"), "position": F.col("position") + 3 * 10**12}
    revised = known.where("quality = 0 and toxic = 0").select(names).withColumns(new)
    none, c = F.lit(None).cast("string"), F.col
    items = table(s, d, "benchmark").select(
        F.lit("pdf").alias("source_type"), none.alias("department"), none.alias("ticket_id"), F.lit("benchmark").alias("doc_id"), none.alias("conversation_id"), c("item_id").cast("string").alias("chunk_id"),
        F.lit("").alias("source"), none.alias("subject"), F.lit("Benchmark").alias("page_title"), F.lit("2024-05-01").alias("last_updated"),
        F.lit("job-c").alias("ingest_job_id"), F.lit("2024-05-02 00:00:00").alias("ingested_at"), "text", (c("item_id") + 4 * 10**12).alias("position"),
    )
    return removed, revised.unionByName(items)


@settled
def catalog_after_delta(s, d):
    """The catalog kept up to date: states of all rows, then of what changed."""
    rows = dataset(s, d)
    removed, added = catalog_changes(s, d)
    kept = stored(catalog.states(rows), "catalog-states")
    gone = removed.select("source_type", "position").distinct()
    now = rows.join(gone, ["source_type", "position"], "left_anti").select(rows.columns).unionByName(added)
    return catalog.finished(catalog.updated(kept, added, removed, now))


AFTER_DELTA = f"""WITH told AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL),
left_documents AS (SELECT d.* FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id WHERE coalesce(toxic, 0) <> 1),
{DATASET.replace('FROM documents', 'FROM left_documents')},
later AS (SELECT * FROM data
UNION ALL SELECT 'pdf', lang, 'doc:' || source, 'https://files.example.org/' || source || '.pdf', source, 0, '2024-05-01 00:00:00', NULL, '2024-05-02 00:00:00', d.doc_id + 3000000000000 FROM documents d JOIN told t ON d.doc_id = t.doc_id WHERE quality = 0 AND toxic = 0
UNION ALL SELECT 'pdf', 'unknown', 'doc:benchmark', NULL, 'Benchmark', 0, '2024-05-01 00:00:00', 'job-c', '2024-05-02 00:00:00', item_id + 4000000000000 FROM benchmark),
newest AS (SELECT type, department, identity, max(ingested_at) AS top FROM later GROUP BY ALL),
starts AS (SELECT type, department, identity, min(position) FILTER (ingested_at = top) AS since FROM later JOIN newest USING (type, department, identity) GROUP BY ALL)
SELECT substr(sha1(type || '|' || department || '|' || identity), 1, 16) AS catalog_id, type AS source_type, department, coalesce(arg_min(source, position), '') AS source,
  nullif({q_host("coalesce(arg_min(source, position), '')")}, '') AS host, arg_min(title, r * 1e13 + position) AS title, count(*) AS chunk_count, max(last_updated) AS last_updated,
  arg_min(job, position) FILTER (job IS NOT NULL AND position >= coalesce(since, 0)) AS ingest_job_id, max(ingested_at) AS ingested_at
FROM later JOIN starts USING (type, department, identity) GROUP BY type, department, identity"""


# ---- incremental ----------------------------------------------------------------------------------------------

LOWER, UPPER = datetime(2024, 1, 10), datetime(2024, 1, 20)


def incremental_window(s, d):
    low, high = incremental_bounds()
    return incremental.in_window(table(s, d, "events"), "ts", low, high).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def incremental_bounds():
    from lexarium.functions.dates import window

    return window(datetime(2024, 1, 12), LOWER, 48, UPPER)


def late_upsert(s, d):
    """Events up to the 20th, then those from two days before on again with the rest: newest event of a user."""
    e = table(s, d, "events")
    return incremental.upsert(e.where(F.col("ts") <= F.lit(UPPER)), e.where(F.col("ts") > F.lit(datetime(2024, 1, 18))), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def latest_per_ticket(s, d):
    return retrieve.date_search(table(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def date_search(s, d):
    rows = table(s, d, "orders").where("o_orderpriority = '1-URGENT'")
    return retrieve.date_search(rows, "o_custkey", "o_orderdate", "o_orderkey", "1995-01-01", "1996-12-31", 100).select("o_custkey", "o_orderkey", "o_totalprice")


def union_sources(s, d):
    rows = dataset(s, d)
    return rows.groupBy("source_type", "department").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


QUERIES = {
    "date_search": date_search,
    "latest_per_ticket": latest_per_ticket,
    "lexical_fold": lexical_fold,
    "hard_split": hard_split,
    "split_long": split_long,
    "noise_flags": noise_flags,
    "clean_lines": clean_lines,
    "clean_messages": clean_messages,
    "phrase_cleanup": phrase_cleanup,
    "html_title": lambda s, d: pages(s, d).select("page_id", html.title(F.col("html")).alias("title")),
    "html_lines": html_lines,
    "html_text": html_text,
    "page_chunks": page_chunks,
    "synthetic_pages": synthetic_pages,
    "page_acceptance": page_acceptance,
    "boost_scoring": boost_scoring,
    "url_canonicalize": url_canonicalize,
    "url_scope": url_scope,
    "department_normalize": department_normalize,
    "doc_keys": doc_keys,
    "merge_keys": merge_keys,
    "conversation_turns": conversation_turns,
    "conversation_chunks": conversation_chunks,
    "contract_validation": contract_validation,
    "profile_conversations": settled(profile_conversations),
    "chunk_quality_report": settled(chunk_quality_report),
    "dedupe_longest": dedupe_longest,
    "chunk_dedupe": chunk_dedupe,
    "merge_all": merge_all,
    "merge_delta": merge_delta,
    "merge_summary": merge_summary,
    "group_replace": group_replace,
    "purge_department": purge_department,
    "migrate_department": migrate_department,
    "ticket_messages_join": ticket_messages_join,
    "catalog_entries": catalog_entries,
    "catalog_filter_page": catalog_filter_page,
    "catalog_page_after": catalog_page_after,
    "catalog_after_delta": catalog_after_delta,
    "catalog_overview": lambda s, d: catalog.overview(catalog_entries(s, d)),
    "catalog_newest": lambda s, d: catalog.newest(catalog_entries(s, d), "web", 6).select("place", "catalog_id", "last_updated"),
    "catalog_tree": lambda s, d: catalog.tree(catalog_entries(s, d)),
    "incremental_window": incremental_window,
    "late_upsert": late_upsert,
    "union_sources": union_sources,
}
ORACLE_SQL = {
    "date_search": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate::DATE BETWEEN '1995-01-01' AND '1996-12-31') WHERE n = 1 ORDER BY o_orderdate DESC, o_custkey::VARCHAR DESC LIMIT 100",
    "latest_per_ticket": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1",
    "lexical_fold": f"SELECT doc_id, sha1(strip_accents(lower({q_normalize('text')}))) AS folded, length({q_collapse('text')}) AS n FROM documents",
    "hard_split": HARD,
    "noise_flags": NOISE,
    "clean_lines": CLEAN,
    "html_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "html_lines": f"WITH {PAGE_LINES} SELECT page_id, i - 1 AS n, l[i] AS line FROM kept, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)",
    "html_text": f"WITH {PAGE_LINES}, t AS (SELECT page_id, {q_normalize('array_to_string(l, chr(10))')} AS text FROM kept) SELECT page_id, length(text) AS n, sha1(text) AS text FROM t",
    "page_acceptance": ACCEPT,
    "boost_scoring": BOOST,
    "url_canonicalize": CANON,
    "url_scope": SCOPE,
    "department_normalize": DEPARTMENT,
    "doc_keys": f"SELECT doc_id, sha1(coalesce(nullif({q_strip('source')}, ''), 'na') || '|na|na|' || doc_id || '|' || substr(sha1(text), 1, 16)) AS doc_key FROM documents",
    "merge_keys": MERGE_KEYS,
    "conversation_turns": TURNS,
    "contract_validation": CONTRACT,
    "profile_conversations": PROFILE,
    "chunk_quality_report": QUALITY,
    "dedupe_longest": "SELECT source, lang, doc_id, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "chunk_dedupe": f"SELECT sha1({q_normalize('text')}) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "merge_all": f"WITH {KEYS} SELECT k AS merge_key, length(text) AS n, 'b' AS ingest_job_id FROM n UNION ALL SELECT k, length(text), 'a' FROM b WHERE k NOT IN (SELECT k FROM n)",
    "merge_delta": f"WITH {KEYS} SELECT k AS merge_key, doc_id, CASE WHEN lang = 'es' THEN 'new' ELSE 'updated' END AS change FROM n WHERE lang <> 'fr'",
    "merge_summary": f"WITH {KEYS} SELECT (SELECT count(*) FROM b) AS base_rows, (SELECT count(*) FROM b) AS base_rows_effective, (SELECT count(*) FROM (SELECT k FROM b UNION SELECT k FROM n)) AS out_rows, count(*) AS new_rows, {KINDS}, 0 AS affected_ticket_groups, 0 AS ticket_rows_removed FROM n",
    "group_replace": f"WITH {KEYS}, e AS (SELECT * FROM b WHERE source NOT IN (SELECT source FROM n WHERE source IS NOT NULL)) SELECT (SELECT count(*) FROM b) AS base_rows, (SELECT count(*) FROM e) AS base_rows_effective, (SELECT count(*) FROM (SELECT k FROM e UNION SELECT k FROM n)) AS out_rows, count(*) AS new_rows, count(*) AS delta_rows, count(*) AS new_count, 0 AS updated_count, 0 AS unchanged_count, count(DISTINCT source) AS affected_ticket_groups, (SELECT count(*) FROM b) - (SELECT count(*) FROM e) AS ticket_rows_removed FROM n",
    "purge_department": "SELECT count(*) AS before, count_if(lang = 'de') AS removed, count_if(lang <> 'de') AS after FROM documents",
    "migrate_department": rf"SELECT department, count(*) AS n, count_if(hit AND was <> 'general') AS changed FROM (SELECT *, CASE WHEN hit THEN 'general' ELSE was END AS department FROM (SELECT regexp_extract(url, '://[^/]*/(\w\w)/', 1) AS was, {q_host('url')} LIKE '%.example.org' AS hit FROM pages)) GROUP BY 1",
    "ticket_messages_join": JOIN,
    "catalog_entries": f"WITH {DATASET} SELECT * FROM entries",
    "catalog_filter_page": f"WITH {DATASET}, f AS (SELECT *, count(*) OVER () AS total FROM entries WHERE source_type = 'web' AND contains(lower(concat_ws(' ', catalog_id, source_type, department, source, host, title)), 'example.org')) SELECT catalog_id, department, title, total, total > 50 AS has_more FROM f ORDER BY source_type, department, lower(coalesce(nullif(title, ''), source, '')), catalog_id LIMIT 25 OFFSET 25",
    "catalog_page_after": f"WITH {DATASET} SELECT catalog_id, source_type, department, title FROM entries WHERE source_type >= 'web' ORDER BY source_type, department, lower(coalesce(nullif(title, ''), source, '')), catalog_id LIMIT 25",
    "catalog_after_delta": AFTER_DELTA,
    "catalog_overview": f"WITH {DATASET} SELECT coalesce(host, nullif(source, ''), catalog_id) AS label, count(*) AS documents, sum(chunk_count)::BIGINT AS chunks, count(DISTINCT department) AS departments, max(last_updated) AS last_updated FROM entries WHERE source_type = 'web' GROUP BY 1",
    "catalog_newest": f"WITH {DATASET} SELECT row_number() OVER (ORDER BY last_updated DESC NULLS LAST, catalog_id) AS place, catalog_id, last_updated FROM entries WHERE source_type = 'web' ORDER BY 1 LIMIT 6",
    "catalog_tree": f"WITH {DATASET} SELECT {SHELF} AS grp, count_if(source_type = 'ticket') AS ticket_count, count_if(source_type = 'web') AS web_count, count_if(source_type = 'pdf') AS pdf_count, sum(chunk_count)::BIGINT AS chunks, count(*) AS children FROM entries GROUP BY 1",
    "incremental_window": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts > '2024-01-10' AND ts <= '2024-01-20' GROUP BY 1",
    "late_upsert": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "union_sources": f"WITH {DATASET} SELECT CASE type WHEN 'web' THEN 'html' ELSE type END AS source_type, CASE WHEN type = 'web' AND department = 'unknown' THEN '' ELSE department END AS department, count(*) AS n, count(DISTINCT source) AS sources FROM data GROUP BY ALL",
}
