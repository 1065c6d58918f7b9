"""Timestamps that arrive as strings."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")


def parse_iso(c: Column) -> Column:
    """ISO with Z, offset or neither, as UTC without fractions; null if it is something else."""
    iso = F.when(F.regexp_like(c, F.lit(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.date_trunc("second", iso.try_cast("timestamp"))


def parse(c: Column) -> Column:
    """The first of ISO and ``FORMATS`` that fits."""
    return F.coalesce(parse_iso(c), *[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def parse_datetime_like(c: Column) -> Column:
    """ISO as ``yyyy-MM-dd HH:mm:ss`` in UTC, a date with day first as an ISO date; what does not parse stays as it is, blank ones are null."""
    trimmed = F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    iso_date = F.when(F.regexp_like(trimmed, F.lit(r"^\d{4}-\d{2}-\d{2}$")), trimmed.try_cast("date")).cast("timestamp")
    day_first = F.when(F.regexp_like(trimmed, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")), F.date_format(F.try_to_timestamp(trimmed, F.lit("d/M/yyyy")), "yyyy-MM-dd"))
    full = F.date_format(F.coalesce(parse_iso(trimmed), iso_date, F.try_to_timestamp(trimmed, F.lit("d/M/yyyy HH:mm:ss"))), FORMATS[0])
    return F.coalesce(full, day_first, trimmed)


def filter_date(value: str | None, name: str = "date") -> date | None:
    """A request's date: ``yyyy-MM-dd``, ``dd/MM/yyyy`` or an ISO time; blank is none, anything else an error."""
    raw = (value or "").strip()
    if not raw:
        return None
    for form in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            return datetime.strptime(raw, form).date()
        except ValueError:
            pass
    try:
        return datetime.fromisoformat(raw.replace("Z", "+00:00")).date()
    except ValueError:
        raise ValueError(f"invalid {name}: use YYYY-MM-DD, DD/MM/YYYY or an ISO datetime") from None


def parse_last_updated(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS[:2]])


def normalized(c: Column) -> Column:
    """ISO values as ``yyyy-MM-dd HH:mm:ss`` in UTC, others as they are, blank ones null."""
    trimmed = F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    date_only = F.when(F.regexp_like(trimmed, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(trimmed, F.lit(" 00:00:00")))
    return F.coalesce(F.date_format(parse_iso(trimmed), FORMATS[0]), date_only, trimmed)


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window(watermark: datetime | None, bootstrap: datetime, overlap_hours: int, now: datetime) -> tuple[datetime, datetime]:
    """(lower, upper]: the watermark less the overlap, not before ``bootstrap``; up to ``now``."""
    if not 0 <= overlap_hours <= 168:
        raise ValueError("overlap_hours must be 0 to 168")
    lower = bootstrap if watermark is None else max(bootstrap, watermark - timedelta(hours=overlap_hours))
    return lower, now


def next_run(now: datetime, every: str, hour: int = 0, minute: int = 0, weekday: int = 0, interval: timedelta | None = None) -> datetime:
    """Next start of an ``interval``, ``daily`` or ``weekly`` (Sunday = 0) schedule."""
    if every == "interval":
        if not interval:
            raise ValueError("interval needed")
        return now + interval
    at = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if every == "daily":
        return at if at > now else at + timedelta(days=1)
    if every == "weekly":
        at += timedelta(days=(weekday - (at.weekday() + 1)) % 7)
        return at if at > now else at + timedelta(days=7)
    raise ValueError(f"unknown schedule: {every}")
