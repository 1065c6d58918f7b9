"""Text scalars as Column functions; all run inside the JVM."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that the counters look for.
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
PHONE = r"(?<!\w)(?:\+?\d[\d\s().-]{6,}\d)(?!\w)"
SIGNATURE = r"(?i)(tel\.?|fax|campus sur|spain|aviso de confidencialidad)"
QUOTE = r"(?m)(^|\n)\s*>\s"
URL = r"https?://"
TECHNICAL = (
    r"(?i)(error|traceback|exception|failed|fatal|module|sbatch|python|\.so\b|/opt/|/home/|gcc|openmpi|cuda|conda|pip"
    r"|make\b|cmake\b|ld:|undefined reference|segmentation fault|slurm|mpi)"
)
TOKEN = r"[a-z0-9_./+\\-]+"


#: What ``\\s`` matches.
WHITE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def normalize(c: Column) -> Column:
    """Carriage returns as line feeds, blanks collapsed, at most one empty line, no space at the ends."""
    c = F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("\n")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_html(c: Column) -> Column:
    return normalize(F.translate(c, " ", " "))


def normalize_lines(c: Column) -> Column:
    """Each line collapsed and trimmed, without empty lines."""
    lines = F.transform(F.split(F.translate(c, "\r", "\n"), "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def collapse(c: Column) -> Column:
    """All white space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def tidy_phrase(c: Column) -> Column:
    """No blanks before punctuation, no punctuation in front."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\s+([,.;:!?])", "$1")
    return normalize(F.regexp_replace(c, r"^\s*[,.;:!?-]+\s*", ""))


def classes(chars) -> str:
    """A character class of ``chars``, as ranges."""
    have = {ord(c) for c in chars}
    starts, ends = (sorted(p for p in have if p + step not in have) for step in (-1, 1))
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


@lru_cache(maxsize=1)
def folds() -> tuple[str, str, str, str]:
    """What compatibility decomposition without marks makes of lower-case characters, by the interpreter's tables.

    (characters that become another one and then those that become none, what the former become, JSON of those that become
    several, a pattern for the latter). Hangul syllables stay whole.
    """
    single, several = {}, {}
    for p in (p for p in range(0xA0, 0x30000) if not 0xAC00 <= p < 0xE000):
        c = chr(p)
        to = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if to != c == c.lower():
            (single if len(to) < 2 else several)[c] = to
    gone = "".join(a for a, b in single.items() if not b)
    return "".join(a for a, b in single.items() if b) + gone, "".join(single.values()), json.dumps(several), classes(several)


def unaccent(c: Column) -> Column:
    """Lower-case letters without marks, compatibility characters as plain ones; ASCII text is only looked at once."""
    given, to, several, spread = folds()

    def folded(x: Column) -> Column:
        many = F.from_json(F.lit(several), "map<string,string>")
        plain = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(many, ch), ch)), "")
        # The long class is tried only where a character beyond Latin-1, or a fraction, stands at all.
        rare = F.regexp_like(x, F.lit(r"[\x{BC}-\x{BE}\x{100}-\x{10FFFF}]")) & F.regexp_like(x, F.lit(spread))
        return F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), F.translate(F.when(rare, plain).otherwise(x), given, to)).otherwise(x)

    return F.element_at(F.transform(F.array(c), folded), 1)


def fold(c: Column) -> Column:
    """Normalised, lower case, without accents: the form in which words are compared."""
    return unaccent(F.lower(normalize(c)))


def tokens(c: Column) -> Column:
    """Words of the folded text; white space is no part of them, so it is not normalised first."""
    return F.regexp_extract_all(unaccent(F.lower(c)), F.lit(TOKEN), F.lit(0))


def first_line(c: Column) -> Column:
    """The first line that is not blank, trimmed; null if none."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1))


def markdown_title(c: Column) -> Column:
    return strip(F.regexp_replace(first_line(c), r"^#+", ""))


def truncate(c: Column, size: int, hint: str = "...[truncated]") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(hint))).otherwise(c)


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def snippet(text: Column, title: Column, size: int = 320, short: int = 80) -> Column:
    """Start of a text without a leading ``Subject:`` line; a short one gets the title in front."""
    body = strip(F.regexp_replace(text, r"(?i)^\s*subject:[^\n]*\n?", ""))
    lacking = (F.length(body) < short) & title.isNotNull() & ~F.contains(F.lower(body), F.lower(title))
    return F.substring(F.when(lacking, F.concat_ws(" - ", title, body)).otherwise(body), 1, size)
