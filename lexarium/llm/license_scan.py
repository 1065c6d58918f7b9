"""License scans: matching statistics against a generalised suffix automaton of licence templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import batch, table

#: Words: runs of 0-9, a-z and characters outside ASCII, of the text with A-Z lower-cased. On UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases whose places are counted, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of public licences and of their usual notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    (
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    (
        "cc-by-nc",
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    ),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your option "
        "any later version",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: Words that a match must have to enter a chain, words between two matches of one chain at most, and the
#: share of a template's words that a chain must cover for its label.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 6, 0.8

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
        (
            "spans",
            pa.list_(
                pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
            ),
        ),
    ]
)
SPARK_SCHEMA = (
    "doc_id long, n_words long, places array<struct<label:string,start:bigint>>, "
    "spans array<struct<label:string,start:bigint,end:bigint,coverage:double>>"
)


class Automaton:
    """Generalised suffix automaton over words of several token sequences.

    ``next[state]`` maps a word to a state, ``link`` and ``length`` are the usual suffix links and longest
    lengths. ``ends[state]`` lists (sequence, end position) of the state's strings, over all occurrences.
    """

    def __init__(self, sequences: list[list[bytes]]):
        self.sequences = sequences
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for s, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w, own)
                own[last].append((s, at + 1))
        self.ends = [set(x) for x in own]
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()
        self.words = {w for seq in sequences for w in seq}

    def _extend(self, last: int, w: bytes, own: list) -> int:
        nxt, link, length = self.next, self.link, self.length

        def split(p: int, q: int) -> int:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            own.append([])
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            return clone

        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else split(last, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append([])
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matched words ending there) for every position that matches anything."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for i, w in enumerate(words):
            to = nxt[v].get(w)
            if to is None:
                while v and to is None:
                    v = link[v]
                    n = length[v]
                    to = nxt[v].get(w)
                if to is None:
                    continue
            v, n = to, n + 1
            yield i, v, n


class Scanner:
    def __init__(self, phrases, templates):
        split = str.split
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.n_phrases = len(phrases)
        self.automaton = Automaton([[w.encode() for w in split(t)] for t in [p for p, _ in phrases] + [t for _, t in templates]])
        self.size = [len(s) for s in self.automaton.sequences]
        a = self.automaton
        #: For each state the phrases that its longest string ends with, shortest first: its own and those of its suffixes.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in a.link]
        for v in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            own = {(self.size[s], s) for s, end in a.ends[v] if s < self.n_phrases and end == self.size[s]}
            self.phrases[v] = self.phrases[a.link[v]] + sorted(x for x in own if a.length[a.link[v]] < x[0] <= a.length[v])

    def scan(self, words: list[bytes]) -> tuple[list[dict], list[dict]]:
        a = self.automaton
        places: list[dict] = []
        matches: list[tuple[int, int, int]] = []  # (start, words, state) of maximal matches
        held = None
        for i, v, n in a.statistics(words):
            for size, s in self.phrases[v]:
                if size <= n:
                    places.append({"label": self.labels[s], "start": i + 1 - size})
            if held and held[0] != i + 1 - n and held[1] >= MIN_MATCH:
                matches.append(held)
            held = (i + 1 - n, n, v)
        if held and held[1] >= MIN_MATCH:
            matches.append(held)
        return places, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of the text that cover enough of a template by matches in the template's order."""
        chains: dict[int, list] = {}  # template -> [start, end in text, end in template, covered words]
        spans: list[dict] = []

        def close(s: int) -> None:
            start, end, _, covered = chains.pop(s)
            if covered >= MIN_COVER * self.size[s]:
                spans.append({"label": self.labels[s], "start": start, "end": end, "coverage": covered / self.size[s]})

        for start, n, v in matches:
            for s, end in sorted(self.automaton.ends[v]):
                if s < self.n_phrases:
                    continue
                now = chains.get(s)
                if now and start <= now[1] + MAX_GAP and end > now[2] and start + n > now[1]:
                    new = min(n, end - now[2], start + n - now[1])
                    chains[s] = [now[0], start + n, end, now[3] + new]
                else:
                    if now and now[3] >= n and start <= now[1] + MAX_GAP:
                        continue
                    if now:
                        close(s)
                    chains[s] = [start, start + n, end, n]
        for s in sorted(chains):
            close(s)
        return sorted(spans, key=lambda x: (x["start"], x["end"], x["label"]))


@lru_cache(maxsize=4)
def scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(phrases, templates)


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """Phrase places and covered template spans of every whole text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Each text's words stream once through
    the automaton; a state and a match length at a word tell every phrase that ends there, and maximal
    matches of ``MIN_MATCH`` words or more are chained in template order. Returns ``doc_id, n_words, places
    array<struct<label,start>>, spans array<struct<label,start,end,coverage>>`` with words counted from 0.
    A null or empty text has no words, places or spans. Overlapping places all count. Repeated rows are
    kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(phrases, templates)
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in SCHEMA}
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = WORD.findall((text.as_py() or "").encode().lower())
                places, spans = s.scan(words)
                for k, v in zip(out, (doc_id, len(words), places, spans), strict=True):
                    out[k].append(v)
            yield batch(out, SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPARK_SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    starts, base = F.col("places.start"), F.col("places.label")
    label_list = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label_list(base).alias("base_labels"),
        label_list(F.concat(base, F.col("spans.label"))).alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.when(F.size("places") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and labels of every document; null and empty texts have no words, labels empty and score 0; repeated rows are kept."""
    return summary(scan_licenses(table(spark, sf_dir, "documents")))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_license_scan`` that phrases alone decide."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def places_sql(phrases: tuple = PHRASES) -> str:
    """DuckDB form of ``license_places``."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(0, len(l)), lambda i: list_slice(l, i + 1, i + {len(p.split())}) = [{', '.join(repr(w) for w in p.split())}])) AS i, '{label}' AS label FROM w"
        for p, label in phrases
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents), f AS ({found}),
g AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY ALL)
SELECT doc_id, len(l) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)"""
