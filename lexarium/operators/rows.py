"""Rows of the dataset's page schema from PDF pages, HTML documents and repository documents, and contract rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import dates, html, ids, text, urls
from lexarium.functions.ids import blank_to_null
from lexarium.operators import chunk
from lexarium.operators.prepare import messages_of_row, page_skip_reason

# Size of a page made of an HTML text, its limit, and the shortest page that is kept.
PAGE_CHARS, PAGE_MOST, LEAST = 2200, 2800, 40
# Parts of file names that tell a department, in order.
FILE_DEPARTMENTS = (
    ("aplicaciones", ("aplicaciones",)), ("sistemas", ("sistemas",)), ("bigdata", ("bigdata", "big_data", "big-data")),
    ("general", ("general",)), ("comunicaciones", ("comunicaciones", "comunicacion")),
)
LINKS = ("link", "source", "ticket_link", "url")
STAMPS = ("lastUpdated", "last_updated", "updated_at", "resolved_at", "closed_at")


def file_department(path: Column) -> Column:
    """Department that a file's name tells, or null."""
    name, out = F.lower(F.substring_index(path, "/", -1)), F.lit(None).cast("string")
    for department, parts in reversed(FILE_DEPARTMENTS):
        told = F.lit(False)
        for p in parts:
            told = told | F.contains(name, F.lit(p))
        out = F.when(told, department).otherwise(out)
    return out


def known_file_department(path: Column) -> Column:
    """As ``file_department``; a name that tells none ends the job."""
    return F.coalesce(file_department(path), F.raise_error(F.concat(F.lit("no department in file name "), path)).cast("string"))


def clean(name: str) -> Column:
    return text.normalize(F.coalesce(F.col(name).cast("string"), F.lit("")))


def optional(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with those of the columns that it lacks, as null strings."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def _accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("skip_reason is null").drop("skip_reason"), rows.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def _page_row(rows: DataFrame, kind: str, department: str, label: str | None, job: str | None, ingested_at: str | None, *more: str) -> DataFrame:
    """Columns of a page row from ``source, extracted_at, page_number, page_total, page_title, text, relpath``."""
    n, c = F.col("page_number"), F.col
    three = F.lpad(n.cast("string"), 3, "0")
    three = F.when(n > 999, n.cast("string")).otherwise(three)
    anchor = F.concat(F.lit("page="), n.cast("string")) if kind == "pdf" else F.concat(F.lit("section-"), three)
    exact = F.concat(c("source"), F.lit("#"), anchor)
    h = F.substring(F.sha1(c("source").cast("binary")), 1, 12)
    given = lambda x: F.lit((x or "").strip())
    message = F.struct(F.lit("assistant").alias("role"), c("text").alias("content"))
    return rows.select(
        exact.alias("link"), "source", exact.alias("source_exact"), F.lit(kind).alias("source_type"), F.lit(department).alias("department"),
        given(label).alias("ingest_label"), given(job).alias("ingest_job_id"),
        F.coalesce(dates.parse_datetime_like(F.lit(ingested_at).cast("string")), c("extracted_at")).alias("ingested_at"),
        c("extracted_at").alias("last_updated"), F.concat(F.lit("doc_"), h, F.lit("_d")).alias("conversation_id"),
        F.concat(F.lit(f"{kind}_"), h).alias("doc_id"), "page_number", "page_total", F.concat(F.lit("page_"), three).alias("page_label"),
        anchor.alias("page_anchor"), "page_title", F.array(message).alias("messages"), F.length("text").alias("char_len"), "relpath", *more,
    )


def pdf_rows(pages: DataFrame, department: str, label: str | None = None, job: str | None = None, ingested_at: str | None = None, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(page rows, counts by skip reason) of ``pages(source, extracted_at, extraction_status, text, page, total_pages, pdf_relpath)``."""
    rows = optional(pages, "pdf_relpath").select(
        clean("source").alias("source"), dates.parse_datetime_like(F.col("extracted_at").cast("string")).alias("extracted_at"), clean("text").alias("text"),
        F.col("page").alias("page_number"), F.col("total_pages").alias("page_total"), clean("pdf_relpath").alias("relpath"),
        page_skip_reason(F.col("source"), F.col("extracted_at"), F.col("extraction_status"), F.col("text"), F.col("page"), F.col("total_pages"), least).alias("skip_reason"),
    )
    good, skipped = _accepted(rows)
    good = good.withColumn("page_title", F.coalesce(text.first_line(F.col("text")), F.lit("")))
    return _page_row(good, "pdf", department, label, job, ingested_at), skipped


def _paged(docs: DataFrame, least: int, target: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows a page, counts by skip reason): documents are skipped as a whole, short pages one by one."""
    good, skipped = _accepted(docs)
    pages = good.withColumn("pages", chunk.synthetic_pages(F.col("text"), target, most)).drop("text")
    pages = pages.withColumn("page_total", F.size("pages")).select("*", F.posexplode("pages").alias("_n", "text")).drop("pages")
    pages = pages.withColumn("page_number", F.col("_n") + 1).drop("_n")
    short = F.length("text") < least
    kept = pages.where(~short).withColumn("page_title", F.coalesce(F.nullif("title", F.lit("")), text.first_line(F.col("text")), F.lit("")))
    too_short = pages.where(short).groupBy(F.lit(f"page text too short (<{least})").alias("skip_reason")).agg(F.count("*").alias("n"))
    return kept, skipped.unionByName(too_short)


def html_rows(
    docs: DataFrame, department: str, label: str | None = None, job: str | None = None, ingested_at: str | None = None,
    least: int = LEAST, target: int = PAGE_CHARS, most: int = PAGE_MOST,
) -> tuple[DataFrame, DataFrame]:
    """(page rows, counts by skip reason) of ``docs(source, extracted_at, extraction_status, text, html_relpath, title)``."""
    c = F.col
    rows = optional(docs, "html_relpath", "title").select(
        clean("source").alias("source"), dates.parse_datetime_like(c("extracted_at").cast("string")).alias("extracted_at"), clean("text").alias("text"),
        clean("title").alias("title"), clean("html_relpath").alias("relpath"),
        page_skip_reason(c("source"), c("extracted_at"), c("extraction_status"), c("text"), least=None).alias("skip_reason"),
    )
    good, skipped = _paged(rows, least, target, most)
    return _page_row(good, "html", department, label, job, ingested_at), skipped


REPO = ("original_url", "canonical_url", "acquisition_url", "provider", "doc_kind", "repo_slug", "repo_namespace", "repo_name")


def repo_relpath(provider: Column, slug: Column, kind: Column, wiki_page: Column, doc_path: Column) -> Column:
    """Place of a repository's document below ``repo_docs``."""
    bare = lambda c: F.nullif(F.btrim(text.normalize(c), F.lit("/")), F.lit(""))
    wiki = F.coalesce(F.concat(F.lit("wiki/"), bare(wiki_page), F.lit(".html")), F.lit("wiki/index.html"))
    tail = F.when(F.lower(text.normalize(kind)) == "wiki", wiki).otherwise(F.coalesce(bare(doc_path), F.lit("README.md")))
    own = F.coalesce(F.nullif(F.lower(text.normalize(provider)), F.lit("")), F.lit("repo_docs"))
    return F.concat_ws("/", F.lit("repo_docs"), own, F.coalesce(bare(slug), F.lit("repo")), tail)


def repo_rows(
    docs: DataFrame, department: str, label: str | None = None, job: str | None = None, ingested_at: str | None = None,
    least: int = LEAST, target: int = PAGE_CHARS, most: int = PAGE_MOST,
) -> tuple[DataFrame, DataFrame]:
    """(page rows with the repository's columns, counts by skip reason) of repository documents.

    ``docs`` has ``source, content, content_format`` (``html`` or plain), the columns ``REPO``, ``page_title, wiki_page_slug,
    doc_path, extracted_at, acquired_at``; missing ones count as null.
    """
    docs = optional(docs, "source", "content", "content_format", "page_title", "wiki_page_slug", "doc_path", "extracted_at", "acquired_at", *REPO)
    c = F.col
    stamp = F.coalesce(*[dates.parse_datetime_like(x) for x in (c("extracted_at").cast("string"), c("acquired_at").cast("string"), F.lit(ingested_at).cast("string"))])
    raw = F.coalesce(c("content"), F.lit(""))
    body = F.when(F.lower(clean("content_format")) == "html", html.fragment_text(raw)).otherwise(text.normalize(raw))
    source = F.coalesce(F.nullif(clean("source"), F.lit("")), F.nullif(clean("canonical_url"), F.lit("")))
    given = {n: F.nullif(clean(n), F.lit("")) for n in REPO}
    rows = docs.select(
        source.alias("source"), stamp.alias("extracted_at"), body.alias("text"), clean("page_title").alias("title"),
        repo_relpath(c("provider"), c("repo_slug"), c("doc_kind"), c("wiki_page_slug"), c("doc_path")).alias("relpath"),
        F.coalesce(given["original_url"], source).alias("original_url"), F.coalesce(given["canonical_url"], source).alias("canonical_url"),
        F.coalesce(given["acquisition_url"], given["canonical_url"], source).alias("acquisition_url"),
        *[given[n].alias(n) for n in REPO[3:]],
    )
    reason = F.when(c("source").isNull(), "missing source").when(c("extracted_at").isNull(), "missing extracted_at").when(c("text") == "", "empty text")
    for name in ("provider", "repo_slug", "doc_kind"):
        reason = reason.when(c(name).isNull(), f"missing {name}")
    good, skipped = _paged(rows.withColumn("skip_reason", reason), least, target, most)
    renamed = good.withColumnRenamed("provider", "repo_docs_provider").withColumnRenamed("doc_kind", "repo_docs_kind")
    return _page_row(renamed, "html", department, label, job, ingested_at, *REPO[:3], "repo_docs_provider", "repo_docs_kind", *REPO[5:]), skipped


def deduped(page_rows: DataFrame) -> DataFrame:
    """Of each exact source and page label the longest row, of equally long ones the first by text."""
    best = F.max_by(F.struct(*page_rows.columns), F.struct("char_len", F.sha1(F.to_json("messages").cast("binary"))))
    return page_rows.groupBy(F.concat_ws("|", "source_exact", "page_label").alias("_k")).agg(best.alias("_row")).select("_row.*")


def contract_rows(rows: DataFrame, department: str, link_template: str = "") -> tuple[DataFrame, DataFrame]:
    """(contract rows, counts by skip reason) of rows of any shape: link, stamp and messages by their fallbacks.

    ``link_template`` makes a link of ``{ticket_id}``. Messages are read by ``messages_of_row`` from the row as JSON.
    """
    every = optional(rows, *LINKS, *STAMPS, "ticket_id", "id", "subject")
    given = lambda n: blank_to_null(F.col(n))
    ticket = F.coalesce(given("ticket_id"), given("id"))
    made = F.replace(F.lit(link_template), F.lit("{ticket_id}"), ticket) if link_template else F.lit(None).cast("string")
    stamp = F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in STAMPS])
    out = every.select(
        F.coalesce(*[given(n) for n in LINKS], made).alias("link"), dates.parse_datetime_like(stamp).alias("last_updated"),
        F.coalesce(ids.department(F.lit(department)), F.lit(department)).alias("department"),
        F.nullif(text.normalize(F.col("subject")), F.lit("")).alias("subject"), messages_of_row(F.to_json(F.struct(*rows.columns))).alias("messages"),
    )
    reason = (
        F.when(F.col("link").isNull(), "missing link")
        .when(F.col("last_updated").isNull(), "missing lastUpdated/last_updated")
        .when(F.size("messages") < 1, "missing messages")
    )
    return _accepted(out.withColumn("skip_reason", reason))


def html_source_url(base: Column, relative: Column) -> Column:
    """Url of a mirrored page: an absolute path as it is, else below the base's host; a path that starts with the host loses it."""
    base = F.rtrim(text.strip(F.coalesce(base, F.lit(""))), F.lit("/"))
    rel = text.strip(F.coalesce(relative, F.lit("")))
    rel = F.when(F.regexp_like(rel, F.lit(r"^(?:https?://|/)")), rel).otherwise(F.regexp_replace(rel, r"^[./]+", ""))
    place = F.regexp_extract(base, r"^(?i:https?)://([^/?#]+)", 1)
    root = F.regexp_extract(base, r"^((?i:https?)://[^/?#]+)", 1)
    own = F.when(F.lower(rel) == F.lower(place), "/").when(F.startswith(F.lower(rel), F.concat(F.lower(place), F.lit("/"))), F.substr(rel, F.length(place) + 1)).otherwise(rel)
    plain = F.when(rel == "", base).otherwise(F.concat_ws("/", base, rel))
    joined = F.when(own == "", root).otherwise(urls.joined(root, own))
    return F.when(F.regexp_like(rel, F.lit("^https?://")), rel).when(place == "", plain).otherwise(joined)


def pdf_source_url(base: Column, relative: Column) -> Column:
    """Url of a mirrored PDF: a base that is one itself, else the path below the base."""
    base = F.rtrim(text.strip(F.coalesce(base, F.lit(""))), F.lit("/"))
    rel = F.ltrim(text.strip(F.coalesce(relative, F.lit(""))), F.lit("/"))
    place = F.regexp_extract(base, r"^(?i:https?)://([^/?#]+)", 1)
    own = F.when(F.lower(rel) == F.lower(place), "").when(F.startswith(F.lower(rel), F.concat(F.lower(place), F.lit("/"))), F.substr(rel, F.length(place) + 2)).otherwise(rel)
    plain = F.when(rel == "", base).otherwise(F.concat_ws("/", base, rel))
    below = F.when(own == "", base).otherwise(urls.joined(F.concat(base, F.lit("/")), own))
    return F.when(base == "", rel).when(place == "", plain).when(F.endswith(F.lower(urls.path(base)), F.lit(".pdf")), base).otherwise(below)


def chunk_id(text_column: Column, conversation: Column, conversation_original: Column, chunk_original: Column) -> Column:
    """An existing chunk id, its prefix set right where the conversation's id was, else one by the text's hash."""
    have, old = blank_to_null(chunk_original), F.coalesce(blank_to_null(conversation_original), F.lit(""))
    prefix = F.concat(old, F.lit("_chunk_"))
    moved = (old != "") & (conversation != old) & F.startswith(have, prefix)
    kept = F.when(moved, F.concat(conversation, F.lit("_chunk_"), F.substr(have, F.length(prefix) + 1))).otherwise(have)
    by_text = F.substring(F.sha1(text.normalize(F.coalesce(text_column, F.lit(""))).cast("binary")), 1, 10)
    return F.coalesce(kept, F.concat(conversation, F.lit("_chunk_"), by_text))
