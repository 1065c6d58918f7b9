"""URL scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 2), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def canonicalize(url: Column) -> Column:
    """Lower-case scheme and host; no query, fragment or final slashes. Null without a scheme."""
    plain = F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, PARTS, 2)), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.regexp_like(url, F.lit(PARTS)), plain)


def scope_prefix(seed: Column) -> Column:
    """Directory of a seed url's path, with a final slash."""
    return F.regexp_replace(F.when(path(seed) == "", "/").otherwise(path(seed)), r"[^/]*$", "")


def in_scope(url: Column, seed: Column) -> Column:
    return (host(url) == host(seed)) & F.startswith(path(url), scope_prefix(seed))


def host_label(h: Column) -> Column:
    """First label of a host without ``www.``: words up to three letters in capitals, others capitalised."""
    bare = F.regexp_replace(F.lower(h), r"^www\.", "")
    words = F.filter(F.split(F.translate(F.substring_index(bare, ".", 1), "-_", "  "), " +"), lambda x: x != "")
    shown = F.transform(
        words,
        lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))),
    )
    return F.when(bare != "", F.when(F.size(words) > 0, F.array_join(shown, " ")).otherwise(bare))


#: Hosts and addresses that must not be fetched, by literal; names are not resolved. Private, loopback, link-local,
#: shared (100.64/10), multicast, reserved, documentation and unspecified addresses, and IPv6 forms of them.
OCTET = r"\.\d{1,3}"
V4 = (
    rf"(?:(?:0|10|127|22[4-9]|23\d|24\d|25[0-5]){OCTET}{OCTET}{OCTET}|169\.254{OCTET}{OCTET}|192\.168{OCTET}{OCTET}|172\.(?:1[6-9]|2\d|3[01]){OCTET}{OCTET}"
    rf"|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7]){OCTET}{OCTET}|192\.0\.[02]{OCTET}|198\.1[89]{OCTET}{OCTET}|198\.51\.100{OCTET}|203\.0\.113{OCTET})"
)
PRIVATE = rf"^(?:localhost|{V4}|\[?::1?\]?|\[?::ffff:{V4}\]?|\[?f[cd][0-9a-f]{{2}}:.*|\[?fe[89ab][0-9a-f]:.*|\[?ff[0-9a-f]{{2}}:.*|\[?2001:db8:.*)$|\.(?:local|internal|localhost)$"


def forbidden_host(h: Column) -> Column:
    return (F.coalesce(h, F.lit("")) == "") | F.regexp_like(F.lower(h), F.lit(PRIVATE))


def joined(base: Column, target: Column) -> Column:
    """``target``, a path without scheme, taken from ``base``'s folder; dots are resolved by ``without_dots``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), r"[^/]*$", "")
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    tail = F.regexp_extract(whole, r"([?#].*)$", 1)
    return F.concat(root, without_dots(F.regexp_replace(whole, r"[?#].*$", "")), tail)


def without_dots(p: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are resolved."""
    parts = F.slice(F.split(p, "/"), 2, 1 << 20)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    end = F.when(last.isin(".", ".."), "/").otherwise("")
    return F.when(~F.regexp_like(p, F.lit(r"(?:^|/)\.\.?(?:/|$)")), p).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, end).otherwise("")))


REPO_FIELDS = (
    "provider", "doc_kind", "host", "repo_slug", "repo_namespace", "repo_name", "original_url", "canonical_url", "acquisition_url",
    "ref", "doc_path", "wiki_page_slug", "is_wiki_root",
)


def classify_repo(url: Column) -> Column:
    """Struct of ``REPO_FIELDS`` of a README or wiki url of github.com or gitlab.com, else null.

    ``/owner/repo/blob/ref/README.md`` and ``/owner/repo/wiki[/page]``; ``/namespace.../repo/-/blob/ref/README.md`` and
    ``/namespace.../repo/-/wikis[/page]``. Empty path segments, query and fragment are ignored; ``repo_problem`` tells what is
    wrong with another url.
    """
    h = host(url)
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    at = lambda i: F.try_element_at(parts, i if isinstance(i, Column) else F.lit(i))
    rest = lambda i: F.nullif(F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "/"), F.lit(""))
    none, web = F.lit(None).cast("string"), F.lit("https://")

    def shape(provider: str, kind: str, namespace, name, canonical, acquisition, ref=none, doc=none, wiki=none) -> Column:
        values = (
            F.lit(provider), F.lit(kind), h, F.concat_ws("/", namespace, name), namespace, name, url, canonical, acquisition,
            ref, doc, wiki, wiki.isNull() if kind == "wiki" else F.lit(False),
        )
        return F.struct(*[v.alias(n) for n, v in zip(REPO_FIELDS, values, strict=True)])

    def page(base: Column, wiki: Column) -> Column:
        return F.concat(base, F.coalesce(F.concat(F.lit("/"), wiki), F.lit("")))

    owner, repo, action = at(1), at(2), F.lower(at(3))
    own = F.concat(web, h, F.lit("/"), owner, F.lit("/"), repo)
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), owner, F.lit("/"), repo, F.lit("/"), at(4), F.lit("/README.md"))
    readme = F.concat(own, F.lit("/blob/"), at(4), F.lit("/README.md"))
    hub_wiki = rest(F.lit(4))
    hub_page = page(F.concat(own, F.lit("/wiki")), hub_wiki)
    github = F.when((action == "blob") & (F.lower(rest(F.lit(5))) == "readme.md"), shape("github", "readme", owner, repo, readme, raw, at(4), rest(F.lit(5)))).when(
        (action == "wiki") & (F.size(parts) >= 3), shape("github", "wiki", owner, repo, hub_page, hub_page, wiki=hub_wiki)
    )
    dash = F.array_position(parts, "-").cast("int")
    space, name, act = F.array_join(F.slice(parts, 1, F.greatest(dash - 2, F.lit(0))), "/"), at(F.greatest(dash - 1, F.lit(1))), F.lower(at(F.greatest(dash + 1, F.lit(1))))
    lab = F.concat(web, h, F.lit("/"), space, F.lit("/"), name, F.lit("/-/"))
    ref, doc = at(dash + 2), rest(dash + 3)
    lab_wiki = rest(dash + 2)
    lab_page = page(F.concat(lab, F.lit("wikis")), lab_wiki)
    gitlab = F.when(
        (act == "blob") & (F.lower(doc) == "readme.md"),
        shape("gitlab", "readme", space, name, F.concat(lab, F.lit("blob/"), ref, F.lit("/README.md")), F.concat(lab, F.lit("raw/"), ref, F.lit("/README.md")), ref, doc),
    ).when(act == "wikis", shape("gitlab", "wiki", space, name, lab_page, lab_page, wiki=lab_wiki))
    ok = scheme(url).isin("http", "https")
    return F.when(ok & h.isin("github.com", "www.github.com"), github).when(ok & h.isin("gitlab.com", "www.gitlab.com") & (dash >= 3), gitlab)


def repo_problem(url: Column) -> Column:
    """Why ``classify_repo`` gives null: ``scheme``, ``host`` or ``shape``; null where it does not."""
    known = host(url).isin("github.com", "www.github.com", "gitlab.com", "www.gitlab.com")
    return F.when(~F.coalesce(scheme(url).isin("http", "https"), F.lit(False)), "scheme").when(~known, "host").when(classify_repo(url).isNull(), "shape")
