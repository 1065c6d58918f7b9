"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import batch, rows_where, slices, table

# Insults that are entries whatever the labels hold.
SEED = ("idiot", "moron", "stupid", "worthless", "scum", "loser", "trash", "pathetic", "disgusting", "clown")
# Phrases in which an entry is harmless; a match inside one does not count.
EXCEPTIONS = ("clown fish", "loser pays", "idiot proof", "trash can", "trash bin", "pond scum", "pathetic fallacy")

#: Bounds of the fit: labelled rows a class in the sample, and characters of such a row (longer ones are not sampled).
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 30_000
#: An entry is a word or a word's first 4 to 7 letters. It explains at least MIN_GAIN positive rows that other entries
#: don't. Strong entries have at most MAX_NEGATIVE negative rows for a positive one; what they leave is explained by
#: weak ones, MIN_ODDS times as frequent in positive rows as in negative ones.
PREFIXES, MIN_GAIN, MAX_NEGATIVE, MIN_ODDS = (4, 5, 6, 7), 3, 0.02, 4
#: Besides those, words in this share of positive rows and no negative one.
COMMON_SHARE = 0.03
#: Length normalisation: strong weight is divided by (1 + words / SCALE) ** POWER; weak entries turn up by chance
#: in long texts, so their weight counts by the words: x SCALE / (words + SCALE / 2).
SCALE, POWER = 200, 0.25

SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("weight", pa.float64()), ("matches", pa.int64())])


def fold_table() -> dict[int, str]:
    """Lower-case letters for homoglyphs, accented letters and digits; a space for other marks."""
    # Characters read as a letter.
    alike = {
        "a": "àáâãäåāăąǎȧаαɑ@4",
        "b": "ьъвβƀ8",
        "c": "çćĉċčсϲ¢",
        "d": "ďđԁɗ",
        "e": "èéêëēĕėęěеёєεэ3€",
        "f": "ƒſ",
        "g": "ĝğġģɡ9",
        "h": "ĥħнһ",
        "i": "ìíîïĩīĭįıіїιɩ1¡",
        "j": "ĵјϳ",
        "k": "ķкκ",
        "l": "ĺļľŀłӏ",
        "m": "мϻ",
        "n": "ñńņňŋпηո",
        "o": "òóôõöøōŏőοоσө0",
        "p": "рρ",
        "q": "ԛ",
        "r": "ŕŗřг",
        "s": "śŝşšѕ$5ß",
        "t": "ţťŧтτ7",
        "u": "ùúûüũūŭůűųυцս",
        "v": "ѵν",
        "w": "ŵωԝш",
        "x": "хχ",
        "y": "ýÿŷуγ",
        "z": "źżžʐ2",
    }
    out = {c: " " for c in range(128) if not chr(c).isalpha()} | {ord(x): y for y, many in alike.items() for x in many}
    out |= {c: " " for c in (*range(0x80, 0xC0), *range(0x2000, 0x2070)) if not chr(c).isalpha()} | {0xAD: "", 0x200B: "", 0x200D: ""}
    out |= {0xFF41 + k: chr(0x61 + k) for k in range(26)} | {c: "" for c in range(0x300, 0x370)}
    return out | {ord(x): y for y, many in alike.items() for x in many}


FOLD = fold_table()
BETWEEN = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")


def fold(text: str) -> str:
    """A text as words of folded letters between single or several spaces, with one at either end."""
    text = text.lower()
    if "!" in text or "|" in text:
        text = BETWEEN.sub("i", text)
    return f" {text.translate(FOLD)} "


@dataclass
class Lexicon:
    """Entries begin with a space (a word's start); those that end with one match whole words only."""

    weights: dict[str, float]
    weak: frozenset[str]
    exceptions: tuple[str, ...]
    slopes: tuple[float, float]
    intercept: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w, entry in self.weak))
        for phrase in self.exceptions:
            folded = f" {' '.join(fold(phrase).split())} "
            if folded not in self.weights:
                a.add_word(folded, (len(folded), None, False))
        if len(a):
            a.make_automaton()
        return a

    def weigh(self, folded: str, a) -> tuple[float, float, int]:
        """Strong and weak weight and number of matches: at each matched word the longest entry, unless it
        begins inside an exception phrase."""
        if not len(a):
            return 0.0, 0.0, 0
        best: dict[int, tuple[int, float, bool]] = {}
        exempt: list[tuple[int, int]] = []
        for end, (size, w, weak) in a.iter(folded):
            start = end + 1 - size
            if w is None:
                exempt.append((start, end))
            elif start not in best or best[start][0] < size:
                best[start] = (size, w, weak)
        if exempt:
            best = {s: x for s, x in best.items() if not any(lo <= s < hi for lo, hi in exempt)}
        strong = sum(w for _, w, weak in best.values() if not weak)
        return strong, sum(w for _, w, weak in best.values() if weak), len(best)

    @staticmethod
    def normalised(strong: float, weak: float, words: int) -> tuple[float, float]:
        return math.log1p(strong / (1 + words / SCALE) ** POWER), math.log1p(weak * SCALE / (words + SCALE / 2))

    def score(self, strong: float, weak: float, words: int) -> float:
        x = self.normalised(strong, weak, words)
        z = self.slopes[0] * x[0] + self.slopes[1] * x[1] + self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


def near_key(folded: str) -> tuple:
    """Alike for near copies: the smallest hashes of a text's longer words; so a copied text counts once."""
    words = sorted(hashlib.md5(w.encode()).digest() for w in set(folded.split()) if len(w) > 5)
    return tuple(words[:3]) if len(words) > 2 else (folded,)


def learn(texts: list[str], toxic: list[int], seed: tuple = SEED, exceptions: tuple = EXCEPTIONS) -> Lexicon:
    """Choose entries that together explain the positive texts, weigh them by log odds and fit the score."""
    seen, rows = set(), []
    for text, y in zip(texts, toxic, strict=True):
        f = fold(text)
        if (key := (near_key(f), y)) not in seen:
            seen.add(key)
            rows.append((f, y))
    positive = [features(f) for f, y in rows if y]
    n_pos, n_neg = len(positive), len(rows) - len(positive)
    pos = Counter(x for own in positive for x in own)
    known = {x for x, n in pos.items() if n >= MIN_GAIN}
    neg: Counter = Counter()
    for f, y in rows:
        if not y:
            neg.update(known & features(f))
    clear = {x for x in known if neg[x] <= MAX_NEGATIVE * pos[x]}
    strong, left = explain([own & clear for own in positive], lambda x, n: (n, -neg[x], x[-1] == " ", len(x), x))
    common = max(2 * MIN_GAIN, COMMON_SHARE * n_pos)
    strong |= {x for x in clear if x[-1] == " " and pos[x] >= common and not neg[x]}
    rest = [own for own in positive if not own & strong]
    likely = {x for x in known if pos[x] * (n_neg + 1) >= MIN_ODDS * (neg[x] + 1) * (n_pos + 1)}
    weak, _ = explain(
        [own & likely for own in rest], lambda x, n: (n / max(1, len(rest)) - neg[x] / max(1, n_neg), x[-1] == " ", len(x), x)
    )
    weak -= strong
    weights = {f" {' '.join(fold(w).split())} ": 2.0 for w in seed}
    base = math.log((n_neg + 1) / (n_pos + 1))
    weights |= {x: max(0.1, math.log((pos[x] + 0.5) / (neg[x] + 0.5)) + base) for x in sorted(strong | weak)}
    lexicon = Lexicon(weights, frozenset(weak), exceptions, (3.0, 1.0), -2.5)
    a = lexicon.automaton()
    xs = [lexicon.normalised(*lexicon.weigh(f, a)[:2], f.count(" ")) for f, _ in rows]
    if n_pos >= 5 and n_neg >= 5:
        lexicon.slopes, lexicon.intercept = logistic(xs, [y for _, y in rows])
    return lexicon


def explain(rows: list[set[str]], worth) -> tuple[set[str], list[set[str]]]:
    """Greedy cover: entries of most worth until none explains MIN_GAIN further rows; and the rows left."""
    chosen: set[str] = set()
    gain = Counter(x for own in rows for x in own)
    while gain:
        top = max(gain, key=lambda x: worth(x, gain[x]) if gain[x] >= MIN_GAIN else (-1,))
        if gain[top] < MIN_GAIN:
            break
        chosen.add(top)
        for own in rows:
            if top in own:
                gain.subtract(own)
        rows = [own for own in rows if top not in own]
        gain = +gain
    return chosen, rows


def logistic(xs: list[tuple[float, float]], ys: list[int]) -> tuple[tuple[float, float], float]:
    """Slopes (not negative) and intercept by damped Newton steps with a small ridge."""
    import numpy as np

    x, y = np.array(xs), np.array(ys, float)
    w = np.array([1.0, 1.0, -1.0])
    ridge = np.array([0.1, 0.1, 1e-6])
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    return (float(max(0.5, w[0])), float(max(0.0, w[1]))), float(w[2])


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from labelled rows that are not held out, by a bounded sample of ``SAMPLE_ROWS`` a class.

    The sampled ids come from ``labels`` alone (smallest hashes), so the texts are not shuffled: at most
    2 x ``SAMPLE_ROWS`` ids are broadcast to their scan. Null ids, texts and labels are not used, nor are texts of more than
    ``SAMPLE_CHARS`` characters; of several labels of an id the largest counts, of several texts the first in order.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    order = F.xxhash64("doc_id")
    # labels may cover rows of other tables; a hash order makes the sample the same wherever it runs.
    chosen = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE_ROWS) for y in (1, 0)]
    ids = chosen[0].unionByName(chosen[1])
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(ids), "doc_id")
        .where(F.length("text") <= SAMPLE_CHARS)
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    # One row an id before it gets here: at most 2 x SAMPLE_ROWS texts of SAMPLE_CHARS characters.
    pairs = sorted((r.doc_id, r.text, r.toxic) for r in rows.collect())
    return learn([t for _, t, _ in pairs], [y for _, _, y in pairs])


def assess(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Toxicity of every whole text.

    ``docs`` needs ``doc_id`` and ``text``; nothing else is read. Returns ``doc_id, score (0 to 1), weight (sum
    of matched entries), matches``. A null or empty text has no match and the score of a text without any.
    Repeated rows are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, j in slices([None] * len(texts)):
                out: dict[str, list] = {"doc_id": ids[i:j], "score": [], "weight": [], "matches": []}
                for text in texts.slice(i, j - i):
                    f = fold(text.as_py() or "")
                    strong, weak, n = lexicon.weigh(f, a)
                    out["score"].append(lexicon.score(strong, weak, f.count(" ")))
                    out["weight"].append(strong + weak)
                    out["matches"].append(n)
                yield batch(out, SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, weight double, matches long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with all columns, that score below ``threshold``; null and empty texts stay."""
    built: list = []

    def keep(texts: list[str | None]) -> list[bool]:
        if not built:
            built.append(lexicon.automaton())
        out = []
        for text in texts:
            f = fold(text or "")
            strong, weak, _ = lexicon.weigh(f, built[0])
            out.append(not text or lexicon.score(strong, weak, f.count(" ")) < threshold)
        return out

    return rows_where(docs, keep)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from ``labels``; a null or empty text scores as one without matches, 0.5 counts as toxic.

    Repeated rows are kept; a null id is not held out; other columns are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    scored = assess(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
