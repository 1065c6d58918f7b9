"""Acceptance of rows from the sources: contract checks, skip reasons and message parsing."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarium.functions.ids import blank_to_null
from lexarium.functions.text import normalize

# Role names, and the fields that hold messages or a pair of question and answer.
ROLES = {
    "user": "user", "usuario": "user", "client": "user", "customer": "user", "requester": "user",
    "assistant": "assistant", "agente": "assistant", "agent": "assistant", "support": "assistant", "system": "system",
}
NESTED = ("messages", "turns")
MESSAGE_FIELDS = ("messages", "messages_json", "conversation", "conversation_json", "turns", "thread")
QUESTIONS, ANSWERS, BODIES = ("question", "query"), ("answer", "response"), ("content", "body")
#: How deep messages may be nested.
DEPTH = 20
#: Errors that a report shows.
SHOWN = 40


def contract_errors(link: Column, updated: Column, messages: Column, subject: Column) -> Column:
    """All errors of a row, whose messages are ``array<struct<role,content>>``: none of the others follow a missing list."""
    text = lambda m: blank_to_null(m["content"])
    told = F.transform(
        messages,
        lambda m, i: F.when(m.isNull(), F.format_string("messages[%d] must be an object", i)).when(
            text(m).isNotNull() & blank_to_null(m["role"]).isNull(), F.format_string("messages[%d].role missing/empty", i)
        ),
    )
    empty = ~F.exists(messages, lambda m: F.coalesce(text(m).isNotNull(), F.lit(False))) & blank_to_null(subject).isNull()
    head = (
        F.when(blank_to_null(link).isNull(), "missing/empty 'link'"),
        F.when(blank_to_null(updated.cast("string")).isNull(), "missing 'lastUpdated' or 'last_updated'"),
    )
    listed = F.concat(
        F.array(*head), told, F.array(F.when(empty, "row must contain at least one non-empty messages[].content or a non-empty 'subject'"))
    )
    return F.array_compact(F.when(messages.isNull(), F.array(*head, F.lit("'messages' must be a list"))).otherwise(listed))


def shown(errors: Column, most: int = SHOWN) -> Column:
    """The first errors of a row, for a report; ``contract_errors`` keeps all."""
    return F.slice(errors, 1, most)


def page_skip_reason(
    source: Column, extracted_at: Column, status: Column, text: Column, page: Column | None = None, total: Column | None = None, least: int | None = 40
) -> Column:
    """First reason not to take a page (or, without page numbers, a document), or null. A missing status is none."""
    state, size = F.lower(blank_to_null(status)), F.length(normalize(text))
    out = (
        F.when(blank_to_null(source).isNull(), "missing source")
        .when(blank_to_null(extracted_at.cast("string")).isNull(), "missing extracted_at")
        .when(state.isNotNull() & ~state.isin("ok", "partial"), F.concat(F.lit("status="), state))
        .when(F.coalesce(size, F.lit(0)) == 0, "empty text")
    )
    if least is not None:
        out = out.when(size < least, f"text too short (<{least})")
    if page is not None:
        out = out.when(F.coalesce(page, F.lit(0)) <= 0, "invalid page number").when(F.coalesce(total, F.lit(0)) <= 0, "invalid total pages")
    return out


def skip_histogram(rows: DataFrame, reason: str = "skip_reason") -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def role(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(blank_to_null(c))), F.lit("user"))


def transaction_role(kind: Column, address: Column, organisation: str) -> Column:
    """Role of a ticket's step: a comment by its type, an assistant by a mail address that names the organisation."""
    own = F.contains(F.coalesce(F.lower(address), F.lit("")), F.lit(organisation.lower()))
    return F.when(F.lower(kind) == "comment", "comment").when(own, "assistant").otherwise("user")


def _plain(value) -> str:
    text = re.sub(r"[ \t]+", " ", ("" if value is None or value is False else str(value)).replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _first(row: dict, names: tuple[str, ...]) -> str:
    return next((t for t in (_plain(row.get(n)) for n in names) if t), "")


def parse_messages(value, depth: int = 0) -> list[dict]:
    """Messages in a string, object or list, nested up to ``DEPTH``; a string that is no JSON is a user's text."""
    if value is None:
        return []
    told = lambda text, name="user": [{"role": name, "content": text}] if text else []
    if depth >= DEPTH:
        return told(_plain(value))
    if isinstance(value, str):
        raw = value.strip()
        if raw[:1] in ("[", "{"):
            try:
                return parse_messages(json.loads(raw), depth + 1)
            except ValueError:
                pass
        return told(_plain(raw))
    if isinstance(value, list):
        return [m for v in value for m in parse_messages(v, depth + 1)]
    if isinstance(value, dict):
        inner = next((n for n in NESTED if isinstance(value.get(n), list)), next((n for n in NESTED if n in value), None))
        if inner:
            return parse_messages(value[inner], depth + 1)
        content = _plain(value.get("content"))
        if content:
            return told(content, ROLES.get(str(value.get("role") or "").strip().lower(), "user"))
        return told(_first(value, QUESTIONS)) + told(_first(value, ANSWERS), "assistant")
    return told(_plain(value))


def row_messages(row: dict) -> list[dict]:
    """Messages of a row of unknown shape: of its first field that has some, else a question and answer, else its body."""
    for name in MESSAGE_FIELDS:
        if found := parse_messages(row.get(name)):
            return found
    both = (("user", _first(row, QUESTIONS)), ("assistant", _first(row, ANSWERS)))
    return [{"role": r, "content": t} for r, t in both if t] or [{"role": "user", "content": t} for t in [_first(row, BODIES)] if t]


MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


@F.udf(MESSAGES, useArrow=True)
def messages_of(value: str | None):
    """``parse_messages`` as a column: recursion over untyped JSON has no built-in form."""
    return parse_messages(value)


@F.udf(MESSAGES, useArrow=True)
def messages_of_row(value: str | None):
    """``row_messages`` of a row as JSON."""
    row = json.loads(value) if value else {}
    return row_messages(row) if isinstance(row, dict) else []


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordered_messages(lines: DataFrame, key: str, order: list[str], text: Column) -> DataFrame:
    """Each key's texts as one JSON array in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return lines.groupBy(key).agg(F.to_json(F.transform(items, lambda x: x["text"])).alias("messages_json"), F.count("*").alias("n"))
