"""Plain forms of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def repeated(texts: list[str | None], window: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, size: int = 3) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def jaccard_components(rows: list[tuple[int, str | None]], percent: int = 90) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by_size = sorted((len(s), i) for i, s in sets.items() if s)
    for k, (n, i) in enumerate(by_size):
        for m, j in by_size[k + 1 :]:
            if m * percent > 100 * n:
                break
            if top(i) != top(j):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (n + m - both):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def places(text: str | None, phrases) -> tuple[int, list[tuple[int, str]]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in phrases:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def groups(pairs) -> dict:
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out: dict = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near[x]
    return out
