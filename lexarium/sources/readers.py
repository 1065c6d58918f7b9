"""Scans: JSON lines, documents, relational tables, page files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium import schemas
from lexarium.functions import html
from lexarium.functions.ids import blank_to_null, department
from lexarium.functions.text import normalize
from lexarium.operators.prepare import transaction_role
from lexarium.storage import stored


def jsonl(spark: SparkSession, path: str, schema: str = schemas.DATASET, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are passed over. ``strict``: a line that is no object ends the job, else it gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def jsonl_or_empty(spark: SparkSession, path: str | None, schema: str = schemas.DATASET) -> DataFrame:
    """As ``jsonl`` with departments normalised; no path, or one that does not exist, gives no rows."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows = jsonl(spark, path, schema)
            return rows.withColumn("department", department(F.col("department"), True)) if "department" in rows.columns else rows
    return spark.createDataFrame([], schema)


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines of a JSON-lines file that are not blank; 0 if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.text(path).where(blank_to_null(F.col("value")).isNotNull()).count()


# Fields that a document keeps besides its text, its source, department and time of update.
METADATA = (
    "conversation_id", "chunk_id", "ticket_id", "source_type", "original_url", "canonical_url", "acquisition_url", "repo_docs_provider",
    "repo_docs_kind", "repo_slug", "repo_namespace", "repo_name", "page_title", "page_number", "page_total", "page_label", "chunk_in_page",
    "char_len", "ingest_label", "ingest_job_id", "ingested_at", "conversation_id_original", "chunk_id_original",
)


def documents(rows: DataFrame) -> DataFrame:
    """Dataset rows as documents: normalised text and the fields ``METADATA``, without rows that have no text.

    The source falls back to ``link``, the time of update to ``lastUpdated``; departments are normalised; fields that ``rows`` lacks are
    null.
    """
    given = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    some = lambda *names: F.coalesce(*[F.nullif(given(n).cast("string"), F.lit("")) for n in names])
    own = [c for c in rows.columns if c not in {"text", "source", "link", "last_updated", "lastUpdated", "department", *METADATA}]
    out = rows.select(
        normalize(F.coalesce("text", F.lit(""))).alias("text"), some("source", "link").alias("source"), some("last_updated", "lastUpdated").alias("last_updated"),
        department(given("department"), True).alias("department"), *[given(n).alias(n) for n in METADATA], *own,
    )
    return out.where(F.length("text") > 0)


def html_files(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """``(path, html)`` of all .html files below a folder, by path; the first ``limit`` of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    rows = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def tree_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Files, folders that hold some, and bytes below a folder: one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.countDistinct(F.regexp_replace("path", "/[^/]*$", "")).alias("folders"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def html_documents(pages: DataFrame) -> DataFrame:
    """``(source, html)`` as title, canonical link, text and status; the title stands before a text that lacks it."""
    t, body = html.title(F.col("html")), html.text(F.col("html"))
    lacking = t.isNotNull() & ~F.contains(F.lower(body), F.lower(t))
    out = pages.withColumns({"title": t, "canonical": html.canonical_href(F.col("html")), "body": body})
    text = F.when(lacking & (F.col("body") != ""), F.concat_ws("\n\n", "title", "body")).otherwise(F.col("body"))
    status = F.when(F.col("html").isNull(), "error").when(F.col("body") == "", "empty").otherwise("ok")
    return out.select("source", "title", "canonical", text.alias("text"), F.length(text).alias("char_len"), status.alias("extraction_status"))


def relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table by JDBC, read in ranges of a numeric key, 500 rows a fetch."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "500")
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def tickets_with_messages(
    tickets: DataFrame, transactions: DataFrame, attachments: DataFrame, users: DataFrame, lower, upper, organisation: str = "", queues: list[str] | None = None, statuses: list[str] | None = None
) -> DataFrame:
    """Tickets updated in (lower, upper] with their messages in order; tickets without transactions stay.

    Of a transaction the first attachment with content counts. Steps of people whose address names the ``organisation`` are an
    assistant's. With ``queues`` only their tickets are taken, each with its ``place`` in its queue by update and id; with ``statuses`` (as
    ``["resolved"]``) only tickets whose ``Status`` is one of them.
    """
    tickets = tickets if statuses is None else tickets.where(F.col("Status").isin(*statuses))
    window = tickets.where((F.col("LastUpdated") > F.lit(lower)) & (F.col("LastUpdated") <= F.lit(upper)))
    if queues is not None:
        order = Window.partitionBy("Queue").orderBy("LastUpdated", "id")
        window = window.where(F.col("Queue").isin(*queues)).withColumn("place", F.row_number().over(order))
    content = attachments.where("Content is not null and Content <> ''").groupBy("TransactionId").agg(F.min_by("Content", "id").alias("content"))
    steps = transactions.where("ObjectType = 'RT::Ticket' and Type in ('Create', 'Correspond', 'Comment')").withColumnRenamed("id", "step")
    steps = steps.join(content, steps.step == content.TransactionId, "left").join(users.select(F.col("id").alias("Creator"), "EmailAddress"), "Creator", "left")
    role = transaction_role(F.col("Type"), F.col("EmailAddress"), organisation) if organisation else F.when(F.col("Type") == "Comment", "comment").otherwise("user")
    items = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("Created", "step", role.alias("role"), "content"))))
    told = steps.groupBy("ObjectId").agg(items.alias("messages"))
    return window.join(told, window.id == told.ObjectId, "left").drop("ObjectId")


def extraction_summary(rows: DataFrame) -> DataFrame:
    """Rows by department with the newest update of each and of all."""
    by = rows.groupBy("department").agg(F.count("*").alias("n"), F.max("last_updated").alias("newest"))
    return by.crossJoin(rows.agg(F.max("last_updated").alias("newest_of_all")))


def reached(start: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``(page, step)`` of the first ``most`` pages that ``links(a, b)`` reach from ``start(page)``, breadth first.

    Every step joins the frontier with the links and leaves out what was seen; the limit is the crawl's own.
    """
    seen = stored(start.select("page", F.lit(0).alias("step")).limit(most), "reached")
    step, have = 0, seen.count()
    while have < most:
        step += 1
        frontier = seen.where(F.col("step") == step - 1).join(links, F.col("page") == F.col("a")).select(F.col("b").alias("page")).distinct()
        found = frontier.join(seen.select("page"), "page", "left_anti").orderBy("page").limit(most - have)
        found = stored(found.withColumn("step", F.lit(step)), "reached")
        now = found.count()
        if not now:
            break
        seen, have = stored(seen.unionByName(found), "reached"), have + now
    return seen


def pdf_pages(files: DataFrame) -> DataFrame:
    """``(path, content)`` of PDF files as pages, by the ``pdftotext`` program where executors have it; else status error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"source": [], "page": [], "text": [], "status": []}
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    done = subprocess.run(["pdftotext", "-", "-"], input=content, capture_output=True, timeout=300, check=True)
                    pages = [(p, "ok" if p.strip() else "empty") for p in done.stdout.decode("utf-8", "replace").split("\f")[:-1]]
                except (OSError, subprocess.SubprocessError):
                    pages = [("", "error")]
                for n, (text, status) in enumerate(pages, 1):
                    for k, v in zip(out, (path, n, text, status), strict=True):
                        out[k].append(v)
            yield pa.record_batch([pa.array(out["source"], pa.string()), pa.array(out["page"], pa.int32()), pa.array(out["text"], pa.string()), pa.array(out["status"], pa.string())], names=list(out))

    return files.select("path", "content").mapInArrow(run, "source string, page int, text string, status string")


def pdf_documents(pages: DataFrame) -> DataFrame:
    """Pages by document: text with page marks, pages with text, and error, partial or ok."""
    marks = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("status") == "ok", F.struct("page", "text")))),
        lambda x: F.concat(F.format_string("--- PAGE %d ---\n", x["page"]), x["text"]),
    )
    good, bad = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "error")
    status = F.when(good == 0, "error").when(bad > 0, "partial").otherwise("ok")
    return pages.groupBy("source").agg(F.count("*").alias("total_pages"), good.alias("pages_with_text"), status.alias("extraction_status"), F.array_join(marks, "\n\n").alias("text"))
