"""HTML scalars: text, lines, titles and links of a page by pattern."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarium.functions.text import normalize, normalize_html

# Elements that are cut with their content, and menu lines.
CUT_ELEMENTS = ("script", "style", "noscript", "template", "svg", "canvas", "iframe", "header", "nav", "footer")
CUT_CLASSES = (("section", "slurm-search"), ("div", "site-nav"), ("div", "site-masthead"))
MENU_LINES = ("Navigation", "About", "Using", "Installing", "Getting Help", "Slurm Workload Manager", "SchedMD")
MENU_PATTERNS = (
    r"(?i)^\s*version\s+\d+(\.\d+)*\s*$",
    r"(?i)^\s*(overview|release notes|documentation|faq)\s*$",
    r"(?i)^\s*(download|related software|installation guide)\s*$",
    r"(?i)^\s*(mailing lists|support and training|troubleshooting)\s*$",
)
#: The most frequent references, which need no look in the table of all; ``&amp;`` last, for plain replacement.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)

# What is cut, and where lines break.
CUTS = tuple(rf"(?is)<{e}\b[^>]*>.*?</{e}>" for e in CUT_ELEMENTS) + tuple(
    rf"(?is)<{e}\b[^>]*class=[\"'][^\"']*{c}[^\"']*[\"'][^>]*>.*?</{e}>" for e, c in CUT_CLASSES
)
BREAKS = (
    (r"(?is)<br\s*/?>", "\n"),
    (r"(?is)</p\s*>", "\n\n"),
    (r"(?is)</(h1|h2|h3|h4|h5|h6)\s*>", "\n\n"),
    (r"(?is)</(li|tr|dt|dd)\s*>", "\n"),
    (r"(?is)<[^>]+>", " "),
)


@lru_cache(maxsize=1)
def references() -> tuple[str, str, str]:
    """(JSON of all named references, a pattern for those that need no semicolon, JSON of numbers that stand for others)."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    numbers = {str(n): "" for n in (*range(1, 9), 0xB, *range(0xE, 0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0))}
    numbers |= {str(n + plane): "" for n in (0xFFFE, 0xFFFF) for plane in range(0, 0x110000, 0x10000)}
    numbers |= {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {"0": "\ufffd", "13": "\r"}
    return json.dumps(html5), "^(?:" + "|".join(bare) + ")", json.dumps(numbers)


def _numeric(x: Column) -> Column:
    """A piece that starts with a numeric reference, without its ampersand."""
    whole = F.regexp_extract(x, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    hexadecimal = F.regexp_extract(whole, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    decimal = F.regexp_extract(whole, r"^#0*([0-9]+)", 1)
    number = F.when(F.length(hexadecimal) > 7, 0x110000).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int"))
    number = number.when(F.length(decimal) > 8, 0x110000).otherwise(decimal.try_cast("int"))
    odd = F.try_element_at(F.from_json(F.lit(references()[2]), "map<string,string>"), number.cast("string"))
    none = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    char = F.when(odd.isNotNull(), odd).when(none, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    return F.when(whole == "", F.concat(F.lit("&"), x)).otherwise(F.concat(char, F.substr(x, F.length(whole) + 1)))


def _named(x: Column) -> Column:
    """A piece that starts with a name: the whole name's character, else that of the longest beginning that needs no semicolon."""
    names, bare, _ = references()
    table = F.from_json(F.lit(names), "map<string,string>")
    whole, begin = F.regexp_extract(x, r"^[A-Za-z0-9]{1,31};", 0), F.regexp_extract(x, bare, 0)
    told = lambda name: F.concat(F.try_element_at(table, name), F.substr(x, F.length(name) + 1))
    return F.coalesce(F.when(whole != "", told(whole)), F.when(begin != "", told(begin)), F.concat(F.lit("&"), x))


def unescape(c: Column) -> Column:
    """Character references decoded, named and numeric ones, each once: what a decoded one leaves is not read again."""

    def decoded(x: Column) -> Column:
        out = F.when(F.startswith(x, F.lit("#")), _numeric(x))
        for name, char in ENTITIES:
            if name[1] != "#":
                out = out.when(F.startswith(x, F.lit(name[1:])), F.concat(F.lit(char), F.substr(x, F.lit(len(name)))))
        return out.otherwise(_named(x))

    pieces = F.transform(F.split(c, "&"), lambda x, i: F.when(i == 0, x).otherwise(decoded(x)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def body(c: Column) -> Column:
    """What stands between the body tags, else the whole page; comments cut."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", " ")
    inner = r"(?is)<body\b[^>]*>(.*)</body>"
    return F.when(F.regexp_like(c, F.lit(inner)), F.regexp_extract(c, inner, 1)).otherwise(c)


def flat_text(c: Column) -> Column:
    """A page's text with line feeds where blocks end, before lines are sifted."""
    c = body(c)
    for pattern in CUTS:
        c = F.regexp_replace(c, pattern, " ")
    for pattern, to in BREAKS:
        c = F.regexp_replace(c, pattern, to)
    return normalize_html(unescape(c))


def lines(c: Column) -> Column:
    """Lines of ``flat_text`` without menu lines, repeats of the line before and single characters."""
    out = F.transform(F.split(flat_text(c), "\n"), normalize_html)

    def noise(x: Column) -> Column:
        menu = x.isin(*MENU_LINES)
        for pattern in MENU_PATTERNS:
            menu = menu | F.regexp_like(x, F.lit(pattern))
        return (x == "") | menu

    kept = F.filter(out, lambda x: ~noise(x))
    # A repeat counts against the last line kept; one-character lines are never kept.
    start = F.array().cast("array<string>")
    step = lambda acc, x: F.when(
        (F.length(x) < 2) | (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) == x), acc
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(kept, start, step)


def text(c: Column) -> Column:
    return normalize(F.array_join(lines(c), "\n"))


def fragment_text(c: Column) -> Column:
    """Lighter form for pieces of HTML: six kinds of blocks cut, breaks, tags and entities."""
    for e in ("script", "style", "noscript", "svg", "nav", "footer"):
        c = F.regexp_replace(c, rf"(?is)<{e}\b[^>]*>.*?</{e}>", " ")
    for pattern, to in BREAKS:
        c = F.regexp_replace(c, pattern, to)
    return normalize_html(unescape(c))


def title(c: Column) -> Column:
    """First title element, tags as spaces; null if there is none or it is empty."""
    inner = F.regexp_extract(c, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return F.nullif(normalize_html(unescape(F.regexp_replace(inner, r"(?is)<[^>]+>", " "))), F.lit(""))


def canonical_href(c: Column) -> Column:
    tag = F.regexp_extract(c, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
