"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.llm.common import batch, slices, table

#: Characters of a gram; a run of other characters than letters counts as one space.
GRAM = 4
#: Filter: 2**SLOT_BITS words of 64 language bits, and probes a gram.
SLOT_BITS, PROBES = 17, 3
#: Bounds of the fit: rows a language in the sample, characters of such a row at most (longer rows are not
#: sampled), grams kept a language, and the share of a language's sampled rows that must hold a gram.
SAMPLE_ROWS, SAMPLE_CHARS, TOP_GRAMS, MIN_SHARE = 1500, 50_000, 6000, 0.01
#: Characters worked on at once.
PIECE = 1 << 19

SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram hashes, index of the text of each) of lower-cased texts, in pieces of bounded size."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), PIECE):
            # A piece repeats the last characters of the one before, so no gram is lost between them.
            part = text[max(0, at - GRAM + 1) : at + PIECE]
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                yield _hashed(held)
                held, size = [], 0
    if held:
        yield _hashed(held)


def _hashed(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(f" {p} " for _, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat([i for i, _ in parts], [len(p) + 2 for _, p in parts])
    letter = letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters only the first, as a space
    keep[:-1] |= letter[1:] & ~letter[:-1] & (owner[1:] == owner[:-1]) & np.concatenate([[True], ~letter[:-2]])
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    if not len(c):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # A run of two or more kept spaces (one after a word, one before the next) becomes one.
    double = np.concatenate([[False], (c[1:] == 32) & (c[:-1] == 32)])
    c, o = c[~double], owner[keep][~double]
    if len(c) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = c[: len(c) - GRAM + 1]
    for k in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - GRAM + 1 + k]
    same = o[: len(h)] == o[GRAM - 1 :]
    return mix(h[same]), o[: len(h)][same]


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filters: one array of slots, a bit of each slot a language."""

    languages: list[str]
    slots: list[np.ndarray]  # one array for every 64 languages
    false_rate: np.ndarray
    default: str

    @staticmethod
    def places(h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            yield (h + np.uint64(k) * step) & np.uint64((1 << SLOT_BITS) - 1)

    @classmethod
    def build(cls, by_language: dict[str, list[int]], default: str) -> LanguageFilter:
        languages = sorted(by_language)
        slots = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(-(-len(languages) // 64) or 1)]
        for i, lang in enumerate(languages):
            h = np.array(by_language[lang], np.int64).view(np.uint64)
            for p in cls.places(h):
                np.bitwise_or.at(slots[i // 64], p, np.uint64(1 << (i % 64)))
        fill = [(slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))]
        return cls(languages, slots, np.array(fill, np.float64) ** PROBES, default)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hits by text and language, corrected for false positives, and grams by text."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for h, owner in grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            for word, slots in enumerate(self.slots):
                mask = np.full(len(h), ~np.uint64(0))
                for p in self.places(h):
                    mask &= slots[p]
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    found = (mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
                    hits[:, i] += np.bincount(owner[found], minlength=len(texts))
        return np.maximum(0, (hits - total[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999))), total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        plain = [t or "" for t in texts]
        counts, _ = self.count(plain)
        out = []
        for text, c in zip(plain, counts, strict=True):
            if not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
            elif not len(c) or c.max() <= 0:
                out.append((self.default, 0.0))
            else:
                out.append((self.languages[int(c.argmax())], round(float(c.max() / c.sum()), 6)))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> LanguageFilter:
    """Learn a filter from ``text`` and non-null ``lang`` of the rows that are not held out.

    The sample is bounded: about ``SAMPLE_ROWS`` rows a language, chosen by a hash of ``doc_id`` against
    each language's row count. Executors count in how many sampled rows each gram occurs; the driver gets
    the ``TOP_GRAMS`` most frequent grams of each language. Rows with a null text, lang or doc_id are not used, nor are texts of
    more than ``SAMPLE_CHARS`` characters.
    """
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(~held_out(F.col("doc_id")))
    totals = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return LanguageFilter.build({}, "und")
    languages = sorted(totals)
    number, below = F.lit(None).cast("int"), F.lit(-1)
    for i, lang in enumerate(languages):
        number = F.when(F.col("lang") == lang, i).otherwise(number)
        below = F.when(F.col("lang") == lang, round(1e6 * min(1, SAMPLE_ROWS / totals[lang]))).otherwise(below)
    sample = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < below) & (F.length("text") <= SAMPLE_CHARS))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.array(b.column("lang_no").to_pylist())
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                found = [np.empty((0, 2), np.uint64)]
                for h, owner in grams(texts[i:j]):
                    found.append(np.stack([h, owner.astype(np.uint64)], axis=1))
                pairs = np.concatenate(found)
                order = np.lexsort((pairs[:, 0], pairs[:, 1]))
                pairs = pairs[order]
                once = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]) if len(pairs) else np.empty(0, bool)
                pairs = pairs[once]
                lang = of[i:j][pairs[:, 1].astype(np.int64)]
                for k in np.unique(lang):
                    h, n = np.unique(pairs[lang == k, 0], return_counts=True)
                    yield pa.record_batch(
                        {"lang_no": pa.array(np.full(len(h), k, np.int32)), "gram": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))}
                    )

    counts = (
        sample.select(number.alias("lang_no"), "text")
        .mapInArrow(tally, "lang_no int, gram long, n long")
        .groupBy("lang_no", "gram")
        .agg(F.sum("n").alias("n"))
    )
    sizes = {r.lang_no: r["n"] for r in sample.select(number.alias("lang_no")).groupBy("lang_no").agg(F.count("*").alias("n")).collect()}
    least = F.lit(2)
    for k, n in sizes.items():
        least = F.when(F.col("lang_no") == k, max(1 + (n > 20), round(MIN_SHARE * n))).otherwise(least)
    top = Window.partitionBy("lang_no").orderBy(F.desc("n"), "gram")
    kept = counts.where(F.col("n") >= least).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= TOP_GRAMS)
    by_language: dict[str, list[int]] = {lang: [] for lang in languages}
    for r in kept.select("lang_no", "gram").collect():  # at most languages x TOP_GRAMS rows
        by_language[languages[r.lang_no]].append(r.gram)
    return LanguageFilter.build(by_language, max(languages, key=lambda x: (totals[x], x)))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Predicted language of every whole text.

    ``docs`` needs ``doc_id`` and ``text``; nothing else is read. Returns ``doc_id, lang_pred, score``: every
    gram's languages come from one probe of the sliced filter, and the language with most corrected hits
    wins (ties: first in alphabetical order); the score is its share of all languages' hits. ``und`` and 0
    for a null text or one without a letter; a text without any known gram gets the language with most
    training rows and 0. Repeated rows are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in slices(texts):
                told = model.predict(texts[i:j])
                yield batch({"doc_id": ids[i:j], "lang_pred": [x for x, _ in told], "score": [x for _, x in told]}, SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; null, empty and letterless texts are ``und`` with 0, ties go to the first language by name.

    Repeated rows and null ids are kept; other columns of ``documents`` are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
