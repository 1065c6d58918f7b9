"""Query rewriting on the driver: one small string becomes up to six weighted variants."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

# Word lists and weights (semantic, lexical).
MOST = 6
ACCENTS = {
    "que": "qué", "como": "cómo", "cual": "cuál", "cuanto": "cuánto", "cuantos": "cuántos", "cuanta": "cuánta",
    "cuantas": "cuántas", "donde": "dónde", "cuando": "cuándo", "quien": "quién", "quienes": "quiénes",
}
ENGLISH = {
    "que": "what", "es": "is", "son": "are", "como": "how", "instalar": "install", "instalacion": "installation", "en": "in",
    "de": "of", "del": "of", "para": "for", "con": "with", "contenedor": "container", "contenedores": "containers",
    "autenticacion": "authentication", "errores": "errors", "error": "error", "falla": "failure", "fallas": "failures",
    "fallo": "failure", "fallos": "failures",
}
STOP_WORDS = set("a al an and con de del el en for in la las los of or para the un una y".split())
DEFINITION = set("que es what is".split())
INSTALL = set("como instalar how to install installation".split())
CONTAINER = set("contenedor contenedores container containers docker podman enroot pyxis singularity sarus".split())
ERROR = set("error errors errores falla fallas fallo fallos failed failure failures troubleshooting".split())
TEMPLATES = (
    ("definition", (("{accented}", 0.9, 0.1), ("what is {0}", 0.95, 0.9), ("{0} overview", 0.7, 0.6))),
    ("install", (("how to install {0}", 0.9, 0.85), ("{0} installation", 0.75, 0.75))),
    ("container", (("{0} containers", 1.0, 1.0), ("{0} container support", 0.85, 0.8), ("{0} docker podman enroot", 0.7, 0.8))),
    ("error", (("{0} errors", 0.95, 0.95), ("{0} troubleshooting", 0.8, 0.7), ("{0} failed", 0.65, 0.6))),
)


def folded(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9_./+\\-]+", folded(text))


def variants(query: str, correct: Callable[[str], str | None] = lambda w: None) -> list[tuple[str, float, float]]:
    """(text, semantic weight, lexical weight), the query first; repeats (folded) are left out."""
    out: list[tuple[str, float, float]] = []
    seen: set[str] = set()
    query = re.sub(r"[ \t]+", " ", query.replace("\r", "\n")).strip()
    w = words(query)

    def add(text: str, semantic: float, lexical: float) -> None:
        if text.strip() and folded(text) not in seen:
            seen.add(folded(text))
            out.append((text.strip(), semantic, lexical))

    add(query, 1.0, 1.0)
    add(" ".join(w), 0.85, 0.1)
    fixed = [correct(x) or x for x in w]
    if sum(a != b for a, b in zip(fixed, w, strict=True)) == 1:
        add(" ".join(fixed), 0.85, 1.0)
    wanted = {
        "definition": (w[:2] in (["que", "es"], ["what", "is"]), DEFINITION),
        "install": (bool(set(w) & INSTALL), INSTALL),
        "container": (bool(set(w) & CONTAINER), CONTAINER),
        "error": (bool(set(w) & ERROR), ERROR),
    }
    for name, templates in TEMPLATES:
        applies, intent = wanted[name]
        subject = " ".join(x for x in w if x not in intent and x not in STOP_WORDS)
        if applies and subject:
            for template, semantic, lexical in templates:
                add(template.format(subject, accented=f"{ACCENTS['que']} es {subject}"), semantic, lexical)
    add(" ".join(ENGLISH.get(x, x) for x in w), 0.85, 0.75)
    return out[:MOST]


def rerank_queries(query: str, more: list[str] = ()) -> list[str]:
    """A query and its variants in their own, lower and upper case, without repeats, six at most."""
    out: list[str] = []
    for text in (query, *more):
        for form in (text, text.lower(), text.upper()):
            if form.strip() and form not in out:
                out.append(form)
    return out[:MOST]


def exact_token(query: str) -> str | None:
    """The query's only word that is no stop word, if it has three characters or more and is no number."""
    w = [x for x in words(query) if x not in STOP_WORDS]
    return w[0] if len(w) == 1 and len(w[0]) >= 3 and not w[0].isdigit() else None
