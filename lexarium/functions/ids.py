"""Keys and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarium.functions.text import collapse, normalize, strip, unaccent

# Departments and the names that stand for them.
DEPARTMENTS = ("aplicaciones", "sistemas", "bigdata", "general", "comunicaciones", "slurm")
ALIASES = (
    ("aplicaciones", ("aplicacion", "aplicacions", "aplicaciones", "aplicaiones", "application", "applications")),
    ("sistemas", ("sistema", "sistemas", "system", "systems")),
    ("bigdata", ("bigdata", "big_data", "big-data", "big data", "bd")),
    ("general", ("general",)),
    ("comunicaciones", ("comunicacion", "comunicaciones", "comunicacions", "communication", "communications")),
    ("slurm", ("slurm",)),
)
MISSING = 10**15


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def _alias(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, many in ALIASES:
        out = F.when(c.isin(*many), name).otherwise(out)
    return out


def department(c: Column, allow_unknown: bool = False) -> Column:
    """Canonical department of a free-form name; unknown names cleaned up, or null."""
    raw = strip(F.regexp_replace(unaccent(F.lower(c)), r"[^\x00-\x7F]", ""))
    clean = F.regexp_replace(F.regexp_replace(raw, r"[\s/]+", "_"), r"[^a-z0-9_-]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[_-]{2,}", "_"), r"^[_-]+|[_-]+$", "")
    found = F.coalesce(_alias(raw), _alias(clean), F.nullif(clean, F.lit("")))
    return found if allow_unknown else F.when(found.isin(*DEPARTMENTS), found)


def valid_department(c: Column) -> Column:
    """The normalised name if the given one has no unsafe character and is 3 to 32 characters, else null."""
    lowered = strip(F.lower(c))
    ok = ~F.regexp_like(lowered, F.lit(r"[^a-z0-9 _\-/]")) & F.regexp_like(department(c, True), F.lit(r"^[a-z0-9][a-z0-9_-]{2,31}$"))
    return F.when(ok, department(c, True))


def valid_name(name: str) -> str | None:
    """``valid_department`` of one name, for arguments that are checked before a job starts."""
    lowered = name.strip(" \t\n\x0b\f\r").lower()
    if re.search(r"[^a-z0-9 _\-/]", lowered):
        return None
    clean = re.sub(r"[_-]{2,}", "_", re.sub(r"[ /]+", "_", lowered)).strip("_-")
    known = {alias: one for one, many in ALIASES for alias in many}
    found = known.get(lowered) or known.get(clean) or clean
    return found if re.fullmatch(r"[a-z0-9][a-z0-9_-]{2,31}", found) else None


def required_department(c: Column) -> Column:
    """As ``valid_department``; an invalid name ends the job."""
    return F.coalesce(valid_department(c), F.raise_error(F.concat(F.lit("invalid department: "), F.coalesce(c, F.lit("none")))).cast("string"))


def safe_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(MISSING))


def text_sha1(c: Column) -> Column:
    return F.sha1(collapse(F.coalesce(c, F.lit(""))).cast("binary"))


def doc_key(source: Column, ticket: Column, conversation: Column, chunk: Column, text: Column) -> Column:
    parts = [F.coalesce(blank_to_null(c), F.lit("na")) for c in (source, ticket, conversation, chunk)]
    return F.sha1(F.concat_ws("|", *parts, F.substring(F.sha1(text.cast("binary")), 1, 16)).cast("binary"))


def merge_key(source: Column, chunk_original: Column, ticket: Column, conversation: Column, text: Column) -> Column:
    """Source and original chunk id; else source and text hash; else ticket, conversation and text hash."""
    s, k = blank_to_null(source), blank_to_null(chunk_original)
    last = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (ticket, conversation)], text_sha1(text))
    return F.when(s.isNotNull() & k.isNotNull(), F.concat_ws("|", s, k)).when(s.isNotNull(), F.concat_ws("|", s, text_sha1(text))).otherwise(last)


def ticket_id(source: Column, conversation: Column) -> Column:
    by_source = F.nullif(F.regexp_extract(source, r"id=(\d+)", 1), F.lit(""))
    return F.coalesce(by_source, F.nullif(F.regexp_extract(conversation, r"^conv_(\d+)$", 1), F.lit(""))).try_cast("bigint")


def ticket_group(source_type: Column, ticket: Column, source: Column, conversation: Column, link: Column | None = None) -> Column:
    """``ticket:<id>`` of rows about tickets, else null; a row without a source is told by its ``link``."""
    source = source if link is None else F.coalesce(blank_to_null(source), blank_to_null(link))
    kind = F.coalesce(strip(F.lower(source_type)), F.lit(""))
    number = F.coalesce(ticket.try_cast("bigint").cast("string"), ticket_id(source, conversation).cast("string"))
    return F.when(kind.isin("", "ticket", "tickets", "conversation"), F.concat(F.lit("ticket:"), number))


def conversation_id(link: Column) -> Column:
    number = F.nullif(F.regexp_extract(link, r"id=(\d+)", 1), F.lit(""))
    return F.concat(F.lit("conv_"), F.coalesce(number, F.substring(F.sha1(F.coalesce(link, F.lit("")).cast("binary")), 1, 10)))


def stable_conversation_id(conversation: Column, source: Column, text: Column) -> Column:
    """The given id, else that of the ticket in the source, else one by source and text."""
    number = F.nullif(F.regexp_extract(source, r"id=(\d+)", 1), F.lit(""))
    seed = F.concat(F.coalesce(strip(source), F.lit("")), F.lit("|"), normalize(F.coalesce(text, F.lit(""))))
    made = F.coalesce(number, F.substring(F.sha1(seed.cast("binary")), 1, 12))
    return F.coalesce(blank_to_null(conversation), F.concat(F.lit("conv_"), made))
