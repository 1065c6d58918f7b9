"""Source catalog: chunks grouped by what they come from, with filter, pages, overview and tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions import dates, urls
from lexarium.functions.ids import blank_to_null
from lexarium.storage import stored

TYPES = ("ticket", "web", "pdf")


def source_type(c: Column) -> Column:
    raw = F.coalesce(F.lower(blank_to_null(c)), F.lit(""))
    return F.when(raw.isin("", "ticket", "tickets", "conversation"), "ticket").when(raw.isin("html", "web", "website"), "web").otherwise(raw)


def identity() -> Column:
    """Ticket or document, else conversation, source or chunk that a row belongs to."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), blank_to_null(F.col(c)))
    own = F.when(F.col("type") == "ticket", part("ticket", "ticket_id")).otherwise(part("doc", "doc_id"))
    row = F.concat(F.lit("row:"), F.substring(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), 1, 16))
    return F.coalesce(own, part("conversation", "conversation_id"), part("source", "source"), part("chunk", "chunk_id"), row)


KEYS = ["type", "department", "identity"]


def typed(rows: DataFrame) -> DataFrame:
    """``rows`` with the keys of their group; timestamps in one form, so that they compare as strings."""
    out = rows.withColumn("type", source_type(F.col("source_type"))).withColumn("identity", identity())
    return out.select(
        "type", F.coalesce(blank_to_null(F.col("department")), F.lit("unknown")).alias("department"), "identity", F.col("position").cast("long").alias("position"),
        *[blank_to_null(F.col(c)).alias(c) for c in ("subject", "page_title", "source", "ingest_job_id")],
        *[dates.normalized(F.col(c)).alias(c) for c in ("last_updated", "ingested_at")],
    )


def states(rows: DataFrame) -> DataFrame:
    """The state of each group of dataset ``rows``: what an entry needs, and what it takes to add rows that come later.

    A job is that of the first row with the newest ingestion or, if it has none, of the first row after it that has one. Rows are
    read a second time only for the groups whose newest ingestion has no job.
    """
    own = typed(rows)
    first, second = F.when(F.col("type") == "ticket", F.col("subject")).otherwise(F.col("page_title")), F.when(F.col("type") == "ticket", F.col("page_title")).otherwise(F.col("subject"))
    rank = F.when(first.isNotNull(), 0).when(second.isNotNull(), 1).when(F.col("source").isNotNull(), 2).otherwise(3)
    own = own.withColumn("title", F.coalesce(first, second, "source")).withColumn("rank", rank)
    job = F.struct("position", "ingest_job_id")
    out = own.groupBy(*KEYS).agg(
        F.count("*").alias("chunk_count"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("position", "source"))).alias("source_at"),
        F.min(F.struct("rank", "position", "title")).alias("title_at"),
        F.max("last_updated").alias("last_updated"),
        F.max(F.when(F.col("ingested_at").isNotNull(), F.struct("ingested_at", (-F.col("position")).alias("before"), "ingest_job_id"))).alias("newest"),
        F.min(F.when(F.col("ingest_job_id").isNotNull(), job)).alias("first_job"),
    )
    lacking = out.where("newest.ingested_at is not null and newest.ingest_job_id is null and first_job is not null").select(*KEYS, (-F.col("newest.before")).alias("since"))
    later = own.where("ingest_job_id is not null").join(lacking, KEYS).where("position > since").groupBy(*KEYS).agg(F.min(job).alias("after"))
    known = F.when(F.col("newest.ingest_job_id").isNotNull(), F.struct((-F.col("newest.before")).alias("position"), F.col("newest.ingest_job_id").alias("ingest_job_id")))
    return out.join(later, KEYS, "left").withColumn("job", F.coalesce(known, "after")).drop("after")


def updated(kept: DataFrame, added: DataFrame, removed: DataFrame, now: DataFrame) -> DataFrame:
    """The states ``kept`` of earlier rows after rows are ``added`` and ``removed``; ``now`` holds the rows that there are afterwards.

    A group that only gets rows behind its own is the sum of two states. A group that loses a row, or gets one between its own, is made
    again from its rows in ``now``, which is read for such groups only. Equal to ``states(now)``.
    """
    delta = stored(states(added), "catalog-delta")
    lost = typed(removed).select(*KEYS).distinct()
    between = delta.join(kept.select(*KEYS, F.col("last").alias("end")), KEYS).where(F.col("first") <= F.col("end")).select(*KEYS)
    again = stored(lost.union(between).distinct(), "catalog-again")
    k, d = kept.join(again, KEYS, "left_anti").alias("k"), delta.join(again, KEYS, "left_anti").alias("d")
    both = k.join(d, KEYS, "full")
    low, high = (lambda c: F.least(f"k.{c}", f"d.{c}").alias(c)), (lambda c: F.greatest(f"k.{c}", f"d.{c}").alias(c))
    older = F.col("d.newest").isNull() | F.coalesce(F.col("k.newest.ingested_at") >= F.col("d.newest.ingested_at"), F.lit(False))
    out = both.select(
        *KEYS, (F.coalesce("k.chunk_count", F.lit(0)) + F.coalesce("d.chunk_count", F.lit(0))).alias("chunk_count"), low("first"), high("last"),
        low("source_at"), low("title_at"), high("last_updated"), high("newest"), low("first_job"),
        F.when(F.col("d.newest").isNull() & F.col("k.newest").isNull(), None).when(older, F.coalesce("k.job", "d.first_job")).otherwise(F.col("d.job")).alias("job"),
    )
    if again.isEmpty():
        return out
    keyed = now.withColumn("_type", source_type(F.col("source_type"))).withColumn("_dept", F.coalesce(blank_to_null(F.col("department")), F.lit("unknown")))
    keyed = keyed.withColumn("type", F.col("_type")).withColumn("_id", identity()).drop("type")
    of = again.select(F.col("type").alias("_type"), F.col("department").alias("_dept"), F.col("identity").alias("_id"))
    return out.unionByName(states(keyed.join(of, ["_type", "_dept", "_id"], "left_semi").select(now.columns)))


def finished(groups: DataFrame) -> DataFrame:
    """The catalog's entries of states."""
    ident = F.substring(F.sha1(F.concat_ws("|", "type", "department", "identity").cast("binary")), 1, 16)
    source = F.coalesce("source_at.source", F.lit(""))
    job = F.when(F.col("newest").isNull(), F.col("first_job.ingest_job_id")).otherwise(F.col("job.ingest_job_id"))
    return groups.select(
        ident.alias("catalog_id"), F.col("type").alias("source_type"), "department", source.alias("source"), F.nullif(urls.host(source), F.lit("")).alias("host"),
        F.col("title_at.title").alias("title"), "chunk_count", "last_updated", job.alias("ingest_job_id"), F.col("newest.ingested_at").alias("ingested_at"),
    )


def entries(rows: DataFrame) -> DataFrame:
    """One row for each type, department and identity of dataset ``rows``, in the order of ``position``.

    ``rows`` has source_type, department, ticket_id, doc_id, conversation_id, chunk_id, source, subject, page_title, last_updated,
    ingest_job_id, ingested_at, text, position (any missing one as null). The first source that is not empty and the title of the
    best kind (subject first for tickets, page title for others) are taken, of several the first; the timestamps are the largest,
    compared in UTC.
    """
    return finished(states(rows))


def listing_order() -> list[Column]:
    return [F.col("source_type"), F.col("department"), F.lower(F.coalesce(F.nullif("title", F.lit("")), F.col("source"), F.lit(""))), F.col("catalog_id")]


def matching(items: DataFrame, kind: str | None = None, department: str | None = None, q: str | None = None) -> DataFrame:
    if kind:
        items = items.where(F.col("source_type") == kind)
    if department:
        items = items.where(F.lower("department") == department.lower())
    if q and q.strip():
        parts = [F.nullif(F.col(c), F.lit("")) for c in ("catalog_id", "source_type", "department", "source", "host", "title")]
        items = items.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(q.strip().lower())))
    return items


def page(items: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in listing order, with ``total`` and ``has_more``."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be 1 or more, size 1 to 100")
    total = items.agg(F.count("*").alias("total"))
    cut = items.orderBy(*listing_order()).offset((number - 1) * size).limit(size)
    return cut.crossJoin(total).withColumn("has_more", F.col("total") > number * size)


def listed(items: DataFrame) -> DataFrame:
    """The entries in ranges of the listing order, sorted: written as a table, a page of it reads the files that it starts in and follows."""
    return items.repartitionByRange(*listing_order()).sortWithinPartitions(*listing_order())


def page_after(items: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The ``size`` entries that follow ``after`` in listing order (none: the first ones), each with its ``cursor``.

    The cursor of a page's last row, as a tuple, is ``after`` of the next page. Nothing is counted and no earlier row is sorted, so a late page
    costs no more than the first; entries that come in or go meanwhile shift no page.
    """
    if not 1 <= size <= 100:
        raise ValueError("size must be 1 to 100")
    if after is not None and len(after) != 4:
        raise ValueError("a cursor has four parts")
    cursor = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(listing_order())])
    if after is not None:
        items = items.where((F.col("source_type") >= after[0]) & (cursor > F.struct(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(after)])))
    return items.withColumn("cursor", cursor).orderBy(*listing_order()).limit(size)


def overview(items: DataFrame) -> DataFrame:
    """Web sources by host (else source, else id): documents, chunks, departments, newest timestamp."""
    web = items.where(F.col("source_type") == "web").withColumn("label", F.coalesce("host", F.nullif("source", F.lit("")), "catalog_id"))
    return web.groupBy("label").agg(
        F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"), F.countDistinct("department").alias("departments"),
        F.max("last_updated").alias("last_updated"),
    )


def overview_buckets(items: DataFrame, limit: int = 6) -> DataFrame:
    """``limit`` rows a type in their order, with each type's total: web sources by host, PDF files and tickets one by one.

    Web sources come by documents, chunks and label, the others by newest ingestion and update.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    none = F.lit(None).cast("string")
    web = overview(items).select(
        F.lit("web").alias("source_type"), "label", F.col("documents").alias("total_documents"), F.col("chunks").alias("total_chunks"),
        F.col("departments").alias("department_count"), "last_updated", none.alias("catalog_id"),
        F.row_number().over(Window.orderBy(F.desc("documents"), F.desc("chunks"), F.lower("label"))).alias("place"),
    )
    newest_first = Window.partitionBy("source_type").orderBy(
        F.desc_nulls_last("ingested_at"), F.desc_nulls_last("last_updated"), F.desc(F.lower(F.coalesce("title", "source"))), F.desc("catalog_id")
    )
    single = items.where(F.col("source_type").isin("pdf", "ticket")).select(
        "source_type", F.coalesce("title", F.nullif("source", F.lit("")), "source_type").alias("label"), F.lit(1).cast("bigint").alias("total_documents"),
        F.col("chunk_count").alias("total_chunks"), F.lit(1).cast("bigint").alias("department_count"), "last_updated", "catalog_id",
        F.row_number().over(newest_first).alias("place"),
    )
    every = web.unionByName(single)
    totals = every.groupBy("source_type").agg(F.count("*").alias("total"))
    return every.where(F.col("place") <= limit).join(totals, "source_type")


def lookup(items: DataFrame, catalog_id: str) -> DataFrame:
    """The entry of an id; no rows if there is none."""
    return items.where(F.col("catalog_id") == catalog_id)


def newest(items: DataFrame, kind: str, limit: int) -> DataFrame:
    order = Window.orderBy(F.desc_nulls_last("last_updated"), "catalog_id")
    top = items.where(F.col("source_type") == kind).orderBy(F.desc_nulls_last("last_updated"), "catalog_id").limit(limit)
    return top.withColumn("place", F.row_number().over(order))


def tree_label() -> Column:
    return F.when(F.col("source_type") == "ticket", "tickets").otherwise(F.coalesce(F.regexp_replace("host", r"^www\.", ""), F.nullif("source", F.lit("")), "catalog_id"))


def tree(items: DataFrame) -> DataFrame:
    """Groups by host without ``www.`` (tickets in one group), with counts by type."""
    return items.withColumn("grp", tree_label()).groupBy("grp").agg(
        *[F.count_if(F.col("source_type") == t).alias(f"{t}_count") for t in TYPES], F.sum("chunk_count").alias("chunks"), F.count("*").alias("children")
    )


def tree_children(items: DataFrame) -> DataFrame:
    """The entries with their group and their place in it, by title: a group's children as rows, so that no group is one value."""
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.lower(F.coalesce("title", "source")), "catalog_id"))
    return items.withColumn("grp", tree_label()).select("grp", place.alias("place"), "catalog_id", "source_type", "title", "source", "chunk_count")
