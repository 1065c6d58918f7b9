"""HTML extraction: two-pass block rules by stop-word density, length and link density."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import batch, table

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was by at be this are from or an not have he she they we you i his her "
    "der die das und in zu den von mit ist des sich auf für im ein eine dem nicht als auch es an werden aus er hat dass sie "
    "nach bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein "
    "le la les de des du et à en un une que qui dans pour par sur pas plus est au ne se ce il elle sont avec son "
    "el los las y del una por con para su al lo como más o pero sus este ya entre".split()
)

# Element names by what they do to the flow of text.
#: Their content is no markup and runs to the closing tag; that of a script or style without one to the page's end.
RAW = frozenset(["script", "style", "title", "noscript", "textarea", "iframe"])
#: Their content is no part of the text; without a closing tag only the tag itself goes.
CUT = frozenset(["template", "select", "option", "svg", "math", "object", "button"])
#: Elements that a page's head may hold; any other one ends it.
HEAD = frozenset(["title", "meta", "link", "base", "script", "style", "noscript", "template"])
BOILERPLATE = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "label"])
CONTENT = frozenset(["article", "main"])
BLOCKS = frozenset(
    "html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address hr details summary center".split()
) | BOILERPLATE | CONTENT
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}

# Parts of class, id and role values that mark an element as no part of the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond "
    "reply replies share sharing social related recommended newsletter subscribe subscription popup modal widget widgets "
    "pagination pager toolbar login signup search complementary contentinfo form".split()
)
#: Of these the ones whose elements never hold the page's article; an article inside another hinted element is one.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply replies "
    "related recommended".split()
)
#: Of the hints those that are words of other matters too (``share-price``, ``social-science``): they count as a whole name, or where the
#: rest of the name tells of a part of a page.
AMBIGUOUS = frozenset(
    "share sharing social related search form alert notice notices respond reply replies menu banner consent modal login recommended "
    "promotion subscription toolbar".split()
)
PARTNERS = frozenset(
    "bar bars block blocks body box button buttons btn card center container content contents desktop dialog element field fixed float global grid group "
    "header heading holder icon icons id img inner input item items js label large layout left link links list main message mobile module "
    "outer overlay page panel post posts right row section site small sticky stories story tab text title toggle tool tools top bottom "
    "articles unit view widget wrap wrapper zone area primary secondary media networks network news this us".split()
)
#: Hints that count outside articles only: an article's own header holds its title.
OUTSIDE_HINTS = frozenset(["header"])

#: A class of these and a hint, as ``has-sidebar``, tells of the page around, not of the element.
ABOUT = frozenset(["has", "with", "no", "without", "is", "not", "hide", "show"])

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TAG_STOP = re.compile(r"[>\"']")
ENDS = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
EDGES = {name: re.compile(rf"<(/?)(?:{name}\b|article\b|main\b)", re.I) for name in CUT}
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none\b", re.I)
WORD = re.compile(r"[^\W\d_]+")

#: Blocks up to this many characters are short; denser links than this are bad (in an article than this, if
#: the rest is running text); stop words from HIGH on are good for a block that is not short, below LOW bad.
SHORT, LINKS, ARTICLE_LINKS, LOW, HIGH = 70, 0.33, 0.8, 0.08, 0.18
#: In an article, so many blocks in a row that are links of at most so many characters are a menu, and so is any such element of a list.
MENU, MENU_CHARS, LISTED = 3, 30, ("li", "ul", "ol", "menu", "dd", "dt", "td")

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def hidden(rest: str) -> bool:
    """Whether a tag has the hidden attribute, ``aria-hidden=true`` or a style without display."""
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
            return True
    return False


def marked(rest: str, in_article: bool) -> int:
    """Whether a tag's class, id or role says that it holds no part of the article: 2 for sure, 1 unless one is inside."""
    found = 0
    for m in MARKS.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            if parts[0] in ABOUT:
                continue
            told = {p for p in parts if p in HINTS}
            rest_of = {p for p in parts if p not in HINTS and p not in PARTNERS and len(p) > 2}
            if told and not (told <= AMBIGUOUS and rest_of) or (not in_article and not OUTSIDE_HINTS.isdisjoint(parts)):
                found = max(found, 1 if NEVER.isdisjoint(parts) else 2)
    return found or (2 if hidden(rest) else 0)


def tags(page: str) -> Iterator[tuple[str, str, str, int]]:
    """Parts of a page: ("text", characters, "", end), ("open", name, attributes, end) and ("close", name, "", end).

    Every character is looked at a bounded number of times: what is not found once (a quote, an end of a comment) is
    not looked for again. Send an end to go on from there.
    """
    at, size = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    quotes = True
    while at < size:
        i = page.find("<", at)
        if i < 0:
            yield "text", page[at:], "", size
            return
        if i > at:
            yield "text", page[at:i], "", i
        follows = page[i + 1 : i + 2]
        if follows in ("!", "?"):
            for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("", ">")):
                if page.startswith(start, i):
                    k = page.find(stop, i + max(2, len(start)))
                    at = size if k < 0 else k + len(stop)
                    break
            continue
        closing = follows == "/"
        name = NAME.match(page, i + 1 + closing)
        if not name or i > last[">"]:
            yield "text", "<", "", i + 1
            at = i + 1
            continue
        k = page.find(">", name.end())
        double, single = page.count('"', name.end(), k), page.count("'", name.end(), k)
        # With pairs of one kind of quote the first > ends the tag; else it may stand in a value.
        if quotes and not closing and (double % 2 or single % 2 or (double and single)):
            p = name.end()
            while (m := TAG_STOP.search(page, p)) and m[0] != ">":
                # A quote opens a value only after an equals sign.
                opens = page[: m.start()].endswith("=") if m.start() < 64 else page[m.start() - 64 : m.start()].rstrip().endswith("=")
                if not opens:
                    p = m.end()
                elif m.start() >= last[m[0]]:
                    m = None
                    break
                else:
                    p = page.find(m[0], m.end()) + 1
            if m:
                k = m.start()
            else:
                quotes = False  # no tag's quotes are matched from here on
        told = yield ("close", name[0].lower(), "", k + 1) if closing else ("open", name[0].lower(), page[name.end() : k], k + 1)
        at = k + 1 if told is None else told
        if told is not None:
            yield "text", "", "", at


def skipped(page: str, name: str, rest: str, end: int, lost: set[str]) -> int:
    """Where the content of a cut or raw element that opens before ``end`` is over; ``end`` if it holds none."""
    if name in lost or (name in CUT and rest.rstrip().endswith("/")):
        return end
    if name in RAW:
        m = ENDS[name].search(page, end)
        if not m and name not in ("script", "style"):
            lost.add(name)
            return end
        k = page.find(">", m.end()) if m else -1
        return len(page) if k < 0 else k + 1
    depth, at = 1, end
    while m := EDGES[name].search(page, at):
        at = m.end()
        if m[0].lower().endswith(("article", "main")) or (not m[1] and name in ("button", "select", "option")):
            return end  # an article in it, or the next one: this one was never closed
        depth += -1 if m[1] else 1
        if not depth:
            k = page.find(">", at)
            return len(page) if k < 0 else k + 1
    lost.add(name)
    return end


class Blocks:
    """Splits a page into blocks: (text, characters inside links, boilerplate 0 to 2, container, element)."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, int, int, str]] = []
        self.parts: list[tuple[str, bool]] = []
        #: Open block elements: (name, inside boilerplate: 0 to 2, container); containers count articles, 0 is the page.
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]
        #: Names on the stack, counted from each article or main element on.
        self.held: list[Counter[str]] = [Counter()]
        self.containers = 0
        self.links = 0
        self.head = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(t for t, _ in self.parts)).split())
            linked = sum(len(t.strip()) for t, link in self.parts if link)
            if text:
                self.out.append((text, linked, *self.stack[-1][1:], self.stack[-1][0]))
            self.parts = []

    def push(self, name: str, boiler: int, container: int) -> None:
        self.stack.append((name, boiler, container))
        if name in CONTENT:
            self.held.append(Counter())
        self.held[-1][name] += 1

    def drop(self) -> str:
        name = self.stack.pop()[0]
        self.held[-1][name] -= 1
        if name in CONTENT:
            self.held.pop()
        return name

    def pop(self, name: str) -> None:
        """Closes the innermost open ``name``; an article or main element is only closed by its own tag or the page's."""
        if name in ("body", "html"):
            if any(h[name] for h in self.held):
                while self.drop() != name:
                    pass
        elif self.held[-1][name]:
            while self.drop() != name:
                pass

    def open(self, name: str, rest: str) -> None:
        if name == "br" or name == "wbr":
            self.parts.append((" " if name == "br" else "", False))
        elif name == "a":
            self.links += 1
        elif name in BLOCKS:
            self.flush()
            self.links = 0
            if self.stack[-1][0] == "p" and name in CLOSES_P or name == self.stack[-1][0] == "li":
                self.drop()
            if name in VOID:
                return
            _, boiler, container = self.stack[-1]
            if name in CONTENT or re.search(r"role\s*=\s*[\"']?main\b", rest, re.I):
                if boiler < 2 and not (container and boiler):  # a reader comment may be an article element too
                    boiler = marked(rest, True) if container or name in CONTENT else 0
                    self.containers += not container
                    container = container or self.containers
            elif name in BOILERPLATE and not (name in ("header", "label") and container):
                # A form may stand around the whole page: an article inside is one, unless the form is no part of it for sure.
                boiler = max(boiler, marked(rest, bool(container)), 1) if name == "form" else 1 if name == "header" else 2
            elif boiler < 2 and name not in ("html", "body") and rest:
                boiler = max(boiler, marked(rest, bool(container)))
            self.push(name, boiler, container)

    def close(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        elif name in BLOCKS:
            self.flush()
            self.links = 0
            self.pop(name)

    def read(self, page: str) -> list[tuple[str, int, int, int, str]]:
        lost: set[str] = set()
        parts = tags(page)
        part = next(parts, None)
        while part:
            kind, name, rest, end = part
            go_on = None
            if kind == "text":
                self.head = self.head and not name.strip()
                if name and not self.head:
                    self.parts.append((name, self.links > 0))
            elif kind == "close":
                self.head = self.head and name != "head"
                self.close(name)
            else:
                self.head = name == "head" or (self.head and name in HEAD)
                if name in RAW or name in CUT:
                    after = skipped(page, name, rest, end, lost)
                    go_on = after if after != end else None
                else:
                    self.open(name, rest)
            part = next(parts, None) if go_on is None else parts.send(go_on)
        self.flush()
        return self.out


def first_pass(text: str, linked: int, boiler: bool, inside: bool, density: float, foreign: bool = False) -> str:
    """good, bad, short (for the second pass), or link (of an article). In a ``foreign`` page stop words tell nothing."""
    if boiler:
        return "bad"
    if linked > LINKS * len(text) and not (inside and linked <= ARTICLE_LINKS * len(text) and (foreign or density >= LOW)):
        # A headline, a paragraph or a source may be one link; what makes a menu is told by its neighbours.
        return "link" if inside else "bad"
    if len(text) <= SHORT:
        return "short"
    if foreign or density >= HIGH:
        return "good"
    return "bad" if density < LOW and not inside else "short"


def kept_blocks(blocks: list[tuple[str, int, int, int, str]], least: int) -> list[str]:
    """Both passes over a page's blocks; elements that boilerplate marks by ``least`` or more are no part of the article.

    Once a page has an article or main element, its content lies there; else all blocks compete. Blocks
    that the first pass leaves open get the label of the nearest decided block of their container (a
    tie: that of the one that follows), never across boilerplate; in an article that decides nothing they are good, in a page bad.
    """
    inside = any(c for *_, c, _ in blocks)
    blocks = [(t, n, boiler >= least, c, name) for t, n, boiler, c, name in blocks if bool(c) == inside]
    words = [[] if boiler else WORD.findall(t.lower()) for t, _, boiler, *_ in blocks]
    stops = [sum(w in STOP_WORDS for w in own) for own in words]
    long = [i for i, (t, n, *_) in enumerate(blocks) if len(t) > SHORT and n <= LINKS * len(t)]
    foreign = sum(stops[i] for i in long) < LOW * sum(len(words[i]) for i in long)
    labels = [
        first_pass(t, n, boiler, bool(c), stop / max(1, len(own)), foreign)
        for (t, n, boiler, c, _), stop, own in zip(blocks, stops, words, strict=True)
    ]
    menus(blocks, labels)
    # A link list or an advert within an article is cut, but decides nothing about the text around it. Nor do elements that are marked, anywhere:
    # no label is inherited across them.
    decided = [None if label == "short" or boiler or (label == "bad" and c) else label for label, (_, _, boiler, c, _) in zip(labels, blocks, strict=True)]
    before, after = [None] * len(blocks), [None] * len(blocks)
    for out, order in ((before, range(len(blocks))), (after, range(len(blocks) - 1, -1, -1))):
        last = None
        for i in order:
            if (last and blocks[last[0]][3] != blocks[i][3]) or (blocks[i][2] and not blocks[i][3]):
                last = None
            out[i] = last
            last = (i, decided[i]) if decided[i] else last
    kept = []
    for i, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label == "short":
            # The one that follows wins a tie: a heading belongs to what it stands above.
            near = [x for x in (after[i], before[i]) if x]
            label = min(near, key=lambda x: abs(x[0] - i))[1] if near else "good" if block[3] else "bad"
        if label == "good":
            kept.append(block[0])
    return kept


def menus(blocks: list[tuple[str, int, bool, int, str]], labels: list[str]) -> None:
    """Decides the blocks of an article that are links: short ones are bad in a list, or ``MENU`` or more in a row; others are good."""
    i = 0
    while i < len(labels):
        j = i + 1
        if labels[i] == "link":
            while j < len(labels) and labels[j] == "link" and blocks[j][3] == blocks[i][3]:
                j += 1
            few = j - i < MENU or any(len(t) > MENU_CHARS for t, *_ in blocks[i:j])
            for k in range(i, j):
                listed = blocks[k][4] in LISTED and len(blocks[k][0]) <= MENU_CHARS
                labels[k] = "good" if few and not listed else "bad"
        i = j


def main_text(page: str | None) -> str:
    """Text of the blocks that are part of the article, joined by two line feeds.

    Where everything stands in elements that names mark as boilerplate, those that may hold an article do; a page
    whose long blocks have hardly any stop words is judged by length and links alone.
    """
    blocks = Blocks().read(page or "")
    return "\n\n".join(kept_blocks(blocks, 1) or kept_blocks(blocks, 2))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every whole page.

    ``pages`` needs ``page_id, url, html``; other columns are ignored. Returns ``page_id, url, text, n_chars``
    (code points). A null or empty html, or one without article text, gives an empty text; a null url stays
    null. Repeated rows are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield batch(
                {
                    "page_id": b.column("page_id").to_pylist(),
                    "url": b.column("url").to_pylist(),
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                },
                SCHEMA,
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty html has an empty one; repeated rows, null ids and null urls are kept."""
    return extract(table(spark, sf_dir, "pages"))
