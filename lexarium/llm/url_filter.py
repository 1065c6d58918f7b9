"""URL filters: longest-rule decisions, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.urls import joined
from lexarium.llm.common import components, stored, table

#: (decision, host, path); a rule fits its host and all subdomains.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, decision) of the longest rule that fits, else null; ties go to the first listed."""
    chosen = F.lit(None).cast("struct<rule:string,decision:string>")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(decision).alias("decision"))).otherwise(chosen)
    return chosen


def canonical_form(url: Column) -> Column:
    """A url without scheme, ``www.``/``m.`` label, query, fragment, ``.html`` and final slashes."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"(\.html)?/*$", ""))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in quotes or not, trimmed; empty if there is none."""
    forms = [rf'(?is)\b{name}\s*=\s*"([^"]*)"', rf"(?is)\b{name}\s*=\s*'([^']*)'", rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)"]
    return F.trim(F.coalesce(*(F.nullif(F.regexp_extract(tag, f, 1), F.lit("")) for f in forms), F.lit("")))


def resolved(base: Column, target: Column) -> Column:
    """A link target as an absolute url, taken from ``base``; null if it names no document or there is nothing to take it from."""
    return (
        F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .when(target.rlike(r"^([?#]|$)"), base)
        .otherwise(joined(base, target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges ``(a, b)`` between canonical forms, from the pages' heads.

    Read from every ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh content="0; url=...">``;
    relative targets are resolved against the page's url (and its first ``<base href>``), forms of which have no scheme; null url or html
    give none.
    """
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh"))
    own = F.concat(F.lit("http://"), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1))
    base = resolved(own, attribute(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href"))
    tags = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    found = found.where(F.col("url").contains("://")).select("url", base.alias("base"), tags.alias("tag"))
    refresh = F.trim(F.regexp_extract(attribute(F.col("tag"), "content"), r"(?is)\burl\s*=\s*[\"']?([^\"']+)", 1))
    is_canonical = F.col("tag").rlike(r"(?is)^<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b")
    is_refresh = F.col("tag").rlike(r"(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")
    target = F.when(is_canonical, attribute(F.col("tag"), "href")).when(is_refresh, refresh)
    found = found.select("url", "base", target.alias("target")).where("target <> ''")
    found = found.select(canonical_form(F.col("url")).alias("a"), resolved(F.col("base"), F.col("target")).alias("to"))
    return found.where("to like '%://%' and a <> ''").select("a", canonical_form(F.col("to")).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """Decide every page: its longest rule, else the decision of its aliases, else allow.

    Urls of one canonical form are aliases, and so are forms joined by ``edges(a, b)`` (default: those of
    ``link_edges``), transitively, by distributed connected components. Among the rule decisions of a
    component an explicit allow goes before any block. A null url, or one without ``://``, has empty
    host and path, fits no rule, has no aliases and is allowed. Repeated rows are kept; extra columns
    are ignored; an empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), canonical_form(F.col("url")).alias("form")).withColumn(
        "own", longest_rule(F.col("host"), F.col("path"), rules)
    )
    edges = link_edges(pages) if edges is None else edges
    groups = components(edges)
    # One row a form, pre-aggregated, so a form that many pages share is one row in the joins below.
    forms = own.where("form <> ''").groupBy("form").agg(
        F.max(F.col("own.decision") == "allow").alias("allowed"), F.max(F.col("own.decision") == "block").alias("blocked")
    )
    forms = stored(
        forms.join(groups, forms.form == groups.node, "left").select(
            "form", F.coalesce("component", "form").alias("component"), "allowed", "blocked"
        ),
        "url-forms",
    )
    told = forms.groupBy("component").agg(
        F.when(F.max("allowed"), "allow").when(F.max("blocked"), "block").alias("inherited")
    )
    # Only blocked components change a page that no rule fits; the others are allowed anyway.
    blocked = forms.join(told.where("inherited = 'block'"), "component").select("form", "inherited")
    return own.join(blocked, "form", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.decision", "inherited", F.lit("allow")).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page; a null url, or one without ``://``, has no host and is allowed; repeated rows are kept."""
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle(rules=RULES) -> str:
    """DuckDB form: rules by a VALUES list, aliases by recursive reachability over the same edges."""
    values = ", ".join(f"('{d}', '{h}', '{p}')" for d, h, p in rules)
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"

    def host(u: str) -> str:
        return f"coalesce(translate(regexp_extract({u}, '{parts}', 1), '{UPPER}', '{LOWER}'), '')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({u}, '{parts}', 2), '')"

    def form(u: str) -> str:
        return rf"regexp_replace({host(u)}, '^(www|m)\.', '') || regexp_replace({path(u)}, '(\.html)?/*$', '')"

    def attr(tag: str, name: str) -> str:
        quoted = rf"regexp_extract({tag}, '(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''>]+))', ['a', 'b', 'c'])"
        return f"trim(coalesce(nullif({quoted}.a, ''), nullif({quoted}.b, ''), nullif({quoted}.c, ''), ''))"

    def absolute(base: str, target: str) -> str:
        root, folder = rf"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')", rf"regexp_replace(regexp_extract({base}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"
        whole = rf"regexp_replace(CASE WHEN starts_with({target}, '/') THEN {target} ELSE CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {target} END, '[?#].*$', '')"
        parts = f"list_transform(string_split({whole}, '/')[2:], lambda x: [x])"
        dots = f"list_reduce(list_prepend([]::VARCHAR[], {parts}), lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[:-2] ELSE list_concat(acc, x) END)"
        return rf"""CASE WHEN regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN {target} WHEN starts_with({target}, '//') THEN 'http:' || {target}
          WHEN regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL WHEN regexp_matches({target}, '^([?#]|$)') THEN {base} ELSE {root} || '/' || array_to_string({dots}, '/') END"""

    return rf"""
WITH RECURSIVE own0 AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {form('url')} AS form FROM pages),
fit AS (SELECT f.host, f.path, arg_max(d, length(h || p)) AS decision, arg_max(h || p, length(h || p)) AS rule
        FROM (SELECT DISTINCT host, path FROM own0) f, (VALUES {values}) r(d, h, p)
        WHERE (f.host = h OR f.host LIKE '%.' || h) AND starts_with(f.path, p) GROUP BY ALL),
own AS (SELECT o.*, f.rule, f.decision FROM own0 o LEFT JOIN fit f USING (host, path)),
tags AS (SELECT {form('url')} AS a, 'http://' || regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS own, {attr("regexp_extract(html, '(?is)<base\\b[^>]*>')", 'href')} AS base,
  unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
targets AS (SELECT a, {absolute('own', 'base')} AS base, CASE WHEN regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b') THEN {attr('tag', 'href')}
  WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN trim(regexp_extract({attr('tag', 'content')}, '(?is)\burl\s*=\s*["'']?([^"'']+)', 1)) END AS target FROM tags),
ends AS (SELECT a, {absolute('base', 'target')} AS target FROM targets WHERE target <> ''),
links AS (SELECT DISTINCT a, {form('target')} AS b FROM ends WHERE target LIKE '%://%' AND a <> ''),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT form, form FROM own WHERE form <> '' UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
told AS (SELECT r.a AS form, bool_or(o.decision = 'allow') AS al, bool_or(o.decision = 'block') AS bl FROM reach r JOIN own o ON o.form = r.b GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN al THEN 'allow' WHEN bl THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN told USING (form)"""
