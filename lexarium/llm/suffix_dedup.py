"""Suffix-array dedup: bytes of long repeated strings, found by a logarithmic family of sparse suffix arrays.

A full suffix array sorts every byte of the corpus; here only content-chosen suffixes are kept (about one in 130
bytes): the leaders of ``suffix_runs``, of which every window of ``window`` bytes has one, at the same place in equal
windows. An array's entries are sorted by the leader's fingerprint and then by a fingerprint of all bytes that
the leader's windows span, which stands for the text that a plain suffix array would compare byte by byte.

Fingerprints of texts, leaders and spans have 64 bits each; a span is only compared under an equal leader.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import lean_writes, scratch, slices, stored, table
from lexarium.llm.fingerprint import Ranges, mix
from lexarium.llm.suffix_runs import GRAM, WORD_GRAM, byte_units, window_runs, word_places, word_values
from lexarium.storage import deleted

#: Bytes of a string, and words of a passage, that must not stand twice.
WINDOW, PASSAGE = 400, 51
#: Batches that the corpus is added in, and offsets of a block in which two suffixes are compared at once.
BATCHES, BLOCK = 4, 32

RUNS = "th long, first int, last int, at int, lead long, cls long"
BLOCKS = "th long, at int, lead long, lo int, hi int, core long, full long"
STARTS = "th long, start int, key long"


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class SuffixIndex:
    """Logarithmic family of suffix arrays: level k holds the merged arrays of 2**k batches, at most one array a level.

    An entry is ``(lead, cls, n, rep)``: a suffix's fingerprints, its occurrences and the first of them; an array is a table
    sorted by ``lead, cls``. ``add`` makes an array of a new batch's suffixes, merge-scans it against the existing levels for
    leaders that occur there too (or twice in the batch), and merges it with the level of its size while there is
    one, so an entry is rewritten a logarithmic number of times. ``repeated`` looks only at the leaders so found.

    With a ``home`` all tables are kept in that folder; ``tables`` names them and ``at`` opens them again, so that a later batch is
    scanned against what was added before. Without one they are scratch tables.
    """

    def __init__(self, window: int = WINDOW, words: bool = False, home: str | None = None):
        self.window, self.words, self.home = window, words, home
        self.levels: dict[int, DataFrame] = {}
        self.texts: list[DataFrame] = []
        self.runs: list[DataFrame] = []
        self.matched: list[DataFrame] = []
        #: Paths of the tables under ``home``.
        self.tables: dict = {"window": window, "words": words, "home": home, "levels": {}, "texts": [], "runs": [], "matched": []}

    @classmethod
    def at(cls, spark: SparkSession, tables: dict) -> SuffixIndex:
        """An index whose tables were kept, by its ``tables`` (JSON keeps them)."""
        out = cls(tables["window"], tables["words"], tables["home"])
        out.tables = {**tables, "levels": {int(k): p for k, p in tables["levels"].items()}}
        out.levels = {k: spark.read.parquet(p) for k, p in out.tables["levels"].items()}
        out.texts, out.runs, out.matched = ([spark.read.parquet(p) for p in tables[n]] for n in ("texts", "runs", "matched"))
        return out

    def _kept(self, df: DataFrame, name: str) -> tuple[DataFrame, str | None]:
        if not self.home:
            return stored(df, name), None
        path = f"{self.home.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        with lean_writes(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), path

    def _entries(self, df: DataFrame) -> DataFrame:
        return df.groupBy("lead", "cls").agg(F.sum("n").alias("n"), F.min("rep").alias("rep")).sortWithinPartitions("lead", "cls")

    def add_runs(self, runs: DataFrame) -> None:
        single = runs.select("lead", "cls", F.lit(1).cast("long").alias("n"), F.struct("th", "first", "last", "at").alias("rep"))
        array, path = self._kept(self._entries(single), "suffix-array")
        found = array.groupBy("lead").agg(F.sum("n").alias("n")).where("n > 1").select("lead")
        for old in self.levels.values():
            found = found.union(array.select("lead").join(old.select("lead"), "lead", "left_semi"))
        matched, place = self._kept(found.distinct(), "suffix-matches")
        self.matched.append(matched)
        self.tables["matched"].append(place)
        level = 0
        while level in self.levels:
            old = self.levels.pop(level)
            gone = self.tables["levels"].pop(level, None)
            merged, merged_path = self._kept(self._entries(old.union(array)), "suffix-array")
            for p in filter(None, (gone, path)):
                deleted(runs.sparkSession, p)
            array, path, level = merged, merged_path, level + 1
        self.levels[level] = array
        if path:
            self.tables["levels"][level] = path

    def add(self, texts: DataFrame, batches: int = 1) -> None:
        """Adds ``texts(th, text)``, distinct ones of ``window`` units or more that the index lacks, in so many batches."""
        if self.home:
            texts, path = self._kept(texts.select("th", "text"), "suffix-texts")
            self.tables["texts"].append(path)
        runs, path = self._kept(texts.sortWithinPartitions("th").mapInArrow(runs_of(self.window, self.words), RUNS), "suffix-runs")
        self.tables["runs"].append(path)
        self.texts.append(texts)
        self.runs.append(runs)
        for k in range(batches):
            self.add_runs(runs.where(F.pmod("th", F.lit(batches)) == k) if batches > 1 else runs)

    def entries(self) -> DataFrame:
        """The entries of all matched leaders, over all levels."""
        leads = union_all(self.matched).distinct()
        found = [a.join(leads, "lead", "left_semi") for a in self.levels.values()]
        return self._entries(union_all(found)) if len(found) > 1 else found[0]

    def repeated(self) -> DataFrame:
        """Runs ``(th, first, last)`` of windows that start anywhere else in the distinct texts too.

        1. Runs with an equal entry are repeated as a whole.
        2. Runs that share only a leader are compared by blocks of offsets: blocks whose common core is unique are
           not repeated, blocks with an equal full span are.
        3. Windows of the blocks that remain open are compared one by one.
        """
        texts, runs = union_all(self.texts), union_all(self.runs)
        entries = stored(self.entries(), "suffix-entries")
        # 1: whole runs
        whole = runs.join(entries.where("n > 1").select("lead", "cls"), ["lead", "cls"]).select("th", "first", "last")
        # 2: one run for each entry under a leader that has several
        several = entries.groupBy("lead").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
        reps = entries.join(several, "lead").select("rep.*", "lead")
        blocks = stored(
            with_items(texts, reps, "first", "last", "at", "lead").mapInArrow(blocks_of(self.window, self.words), BLOCKS), "suffix-blocks"
        )
        by_full = blocks.groupBy("core", "full").agg(
            F.count("*").alias("n"), F.min(F.struct("th", "at", "lead", "lo", "hi")).alias("rep")
        )
        by_full = stored(by_full, "suffix-block-classes")
        equal = blocks.join(by_full.where("n > 1").select("core", "full"), ["core", "full"]).select(
            "th", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last")
        )
        # 3: one block for each full span under a core that has several
        unclear = by_full.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
        still = by_full.join(unclear, "core").select("rep.*")
        starts = with_items(texts, still, "at", "lead", "lo", "hi").mapInArrow(starts_of(self.window, self.words), STARTS)
        starts = stored(starts, "suffix-starts")
        # Counts before the join, so that a window that many texts share is one row on its side.
        common = starts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        single = starts.join(common, "key", "left_semi").select("th", F.col("start").alias("first"), F.col("start").alias("last"))
        return whole.union(equal).union(single)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows whose text this task has had: copies shrink before they are shuffled."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for i, k in enumerate(b.column("th").to_pylist()):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        if keep:
            yield b.take(pa.array(keep))


def runs_of(window: int, words: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keys, texts = b.column("th").to_pylist(), b.column("text").to_pylist()
            new = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]  # sorted by th
            last = keys[-1] if keys else last
            th, raw = np.array([keys[i] for i in new], np.int64), [texts[i] for i in new]
            for i, j in slices(raw):
                found = (
                    window_runs([word_values(t.encode()) for t in raw[i:j]], window, WORD_GRAM)
                    if words
                    else window_runs([t.encode() for t in raw[i:j]], window, GRAM)
                )
                for r in found:
                    yield pa.record_batch(
                        {
                            "th": th[i:j][r["owner"]],
                            **{k: r[k].astype(np.int32) for k in ("first", "last", "at")},
                            "lead": r["lead"],
                            "cls": r["cls"],
                        }
                    )

    return run


def grouped_rows(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]):
    """For each text: its key, hashes of ranges of its bytes, and the arrays of its ``items``."""
    for b in batches:
        for th, text, items in zip(b.column("th").to_pylist(), b.column("text"), b.column("items"), strict=True):
            raw = text.as_py().encode()
            rows = items.values
            yield th, raw, {f: rows.field(f).to_numpy(zero_copy_only=False) for f in fields}


def gathered(columns: Iterator[dict[str, np.ndarray]], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for c in columns:
        held.append(c)
        n += len(c["th"])
        if n >= most:
            yield pa.record_batch({k: np.concatenate([h[k] for h in held]) for k in held[0]})
            held, n = [], 0
    if held:
        yield pa.record_batch({k: np.concatenate([h[k] for h in held]) for k in held[0]})


def blocks_of(window: int, words: bool = False):
    """Each run cut into blocks of offsets from its leader, with fingerprints of what all windows of the block
    share (core) and of all that they span (full)."""

    units = word_values if words else byte_units

    def blocks(batches):
        for th, raw, x in grouped_rows(batches, ("first", "last", "at", "lead")):
            ranges = Ranges(units(raw))
            low, high = x["at"] - x["last"], x["at"] - x["first"]  # offsets of the windows from the leader
            count = high // BLOCK - low // BLOCK + 1
            of = np.repeat(np.arange(len(count)), count)
            number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + (low // BLOCK)[of]
            lo, hi = np.maximum(low[of], number * BLOCK), np.minimum(high[of], number * BLOCK + BLOCK - 1)
            at, lead = x["at"][of].astype(np.int64), x["lead"][of]
            h = mix(lead.view(np.uint64) + number.astype(np.uint64))
            core = mix(h ^ ranges.raw(at - number * BLOCK, at - (number * BLOCK + BLOCK - 1) + window))
            full = mix(core ^ mix(ranges.raw(at - hi, at - lo + window) + (lo * 4096 + hi).astype(np.uint64)))
            yield {
                "th": np.full(len(of), th, np.int64),
                "at": at.astype(np.int32),
                "lead": lead,
                "lo": lo.astype(np.int32),
                "hi": hi.astype(np.int32),
                "core": core.view(np.int64),
                "full": full.view(np.int64),
            }

    return lambda batches: gathered(blocks(batches))


def starts_of(window: int, words: bool = False):
    """Each window of a block, with a fingerprint of its leader, offset and bytes."""

    units = word_values if words else byte_units

    def starts(batches):
        for th, raw, x in grouped_rows(batches, ("at", "lead", "lo", "hi")):
            ranges = Ranges(units(raw))
            count = x["hi"] - x["lo"] + 1
            of = np.repeat(np.arange(len(count)), count)
            d = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + x["lo"][of]
            p = x["at"][of].astype(np.int64) - d
            key = mix(mix(x["lead"][of].view(np.uint64) + d.astype(np.uint64)) ^ ranges.raw(p, p + window))
            yield {"th": np.full(len(of), th, np.int64), "start": p.astype(np.int32), "key": key.view(np.int64)}

    return lambda batches: gathered(starts(batches))


def byte_spans(raw: bytes, first: np.ndarray, last: np.ndarray, words: np.ndarray, window: int, words_window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of runs of windows; those of words count words, a negative last is the text's last window."""
    first, end = first.astype(np.int64), last.astype(np.int64) + window
    if not words.any():
        return first, end
    start, stop = word_places(raw)
    last = np.where(last < 0, len(start) - words_window, last)
    w = np.flatnonzero(words & (last >= 0))
    first[w], end[w] = start[first[w]], stop[last[w] + words_window - 1]
    real = ~words | (last >= 0)
    return first[real], end[real]


def spans_of(window: int, words: int = 0, characters: bool = False):
    """Union of the windows of each text as byte spans, and what is left of the text: with ``characters`` whole ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"th": [], "spans": [], "kept": []}
            for th, raw, x in grouped_rows([b], ("first", "last", "words")):
                first, end = byte_spans(raw, x["first"], x["last"], x["words"].astype(bool), window, words)
                if not len(first):
                    continue
                order = np.argsort(first, kind="stable")
                first, end = first[order], end[order]
                reach = np.maximum.accumulate(end)
                new = np.concatenate([[True], first[1:] > reach[:-1]])
                lo, hi = first[new], reach[np.concatenate([new[1:], [True]])]
                cuts = np.concatenate([[0], np.stack([lo, hi], axis=1).ravel(), [len(raw)]])
                out["th"].append(th)
                out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(lo, hi, strict=True)])
                left = [raw[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)]
                # The text is valid, so what does not decode is a part of a character at an edge of a piece.
                out["kept"].append(b"".join(p.decode(errors="ignore").encode() for p in left) if characters else b"".join(left))
            yield pa.record_batch(
                [
                    pa.array(out["th"], pa.int64()),
                    pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(out["kept"], pa.binary()),
                ],
                names=["th", "spans", "kept"],
            )

    return run


def with_items(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Each text that ``rows`` has rows for, once, with those rows as ``items``: as many as its length bounds."""
    items = rows.groupBy("th").agg(F.collect_list(F.struct(*columns)).alias("items"))
    return texts.join(items, "th").select("th", "text", "items")


def repeated_windows(texts: DataFrame, window: int, batches: int, words: bool = False) -> DataFrame:
    """Runs ``(th, first, last)`` of windows of ``window`` bytes (or words) that start anywhere else in the distinct texts too."""
    index = SuffixIndex(window, words)
    index.add(texts, batches)
    return index.repeated()


def long_texts(docs: DataFrame, least: int) -> DataFrame:
    """``(th, text)`` of the texts of at least so many bytes, each once a task."""
    rows = docs.select(text_key(F.col("text")).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.octet_length("text") >= least).mapInArrow(once_a_task, "th long, text string")


def spans_found(texts: DataFrame, found: DataFrame, window: int, words: int = 0, characters: bool = False) -> DataFrame:
    """``(th, spans, kept)`` of the distinct ``texts`` that ``found(th, first, last, words)`` has runs of windows for."""
    return with_items(texts, found, "first", "last", "words").mapInArrow(
        spans_of(window, words, characters), "th long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def copied(docs: DataFrame, least: int) -> DataFrame:
    """``(th, size)`` of texts that occur several times and have at least so many bytes."""
    rows = docs.select(text_key(F.col("text")).alias("th"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return rows.groupBy("th").agg(F.count("*").alias("n"), F.first("size").alias("size")).where((F.col("n") > 1) & (F.col("size") >= least))


def repeated(
    docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, words: int = 0, characters: bool = False, passages_only: bool = False
) -> DataFrame:
    """Byte spans of every distinct text covered by a ``window``-byte string that starts anywhere else too.

    ``docs`` needs ``text``; a null text counts as empty. Returns a stored table ``th`` (``text_key``), ``spans
    array<struct<start,end>>`` (maximal, in bytes of the UTF-8 text), ``kept binary`` (the other bytes, in
    order) and, with ``words``, ``passages string`` for the texts that have a span; other texts are kept whole. Copies of a text,
    overlapping occurrences and occurrences within one text count. Every step groups by fingerprints after partial aggregation;
    nothing that grows with a group of copies meets in one task.

    With ``words`` (9 at least), ``passages`` is the text without the spans and without passages of so many words that stand
    anywhere else too, whatever their length in bytes and the white space between their words; it has no parts of
    characters that a span cuts. With ``characters`` neither has ``kept``. A text with a passage only has no spans. With
    ``passages_only`` there are no ``spans`` and ``kept``.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lexarium_texts_{uuid.uuid4().hex}"
    least = min(window, 2 * words - 1) if words else window
    # Distinct texts, bucketed, so that the joins below move only their small side.
    with lean_writes(spark):
        long_texts(docs, least).repartition(n, "th").write.bucketBy(n, "th").sortBy("th").format("parquet").option("compression", "zstd").saveAsTable(name)
    try:
        with scratch(spark):
            texts = spark.table(name)
            with scratch(spark):
                found = stored(repeated_windows(texts, window, batches), "repeated-bytes", keep=True).withColumn("words", F.lit(False))
            # Texts that occur several times are repeated as a whole.
            copies = stored(copied(docs, least), "copied-texts")
            whole = copies.where(F.col("size") >= window)
            found = found.union(whole.select("th", F.lit(0), (F.col("size") - window).cast("int"), F.lit(False)))
            once = texts.dropDuplicates(["th"])
            out = spans_found(once, found, window, characters=characters)
            if words:
                with scratch(spark):
                    passages = stored(repeated_windows(texts, words, batches, words=True), "repeated-words", keep=True)
                passages = passages.withColumn("words", F.lit(True)).union(copies.select("th", F.lit(0), F.lit(-1), F.lit(True)))
                both = spans_found(once, found.union(passages), window, words, characters=True)
                both = both.select("th", F.col("kept").cast("string").alias("passages"))
                out = both if passages_only else stored(out, "byte-spans").join(both, "th", "full")
            return stored(out, "repeated-spans", keep=True)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeated(docs: DataFrame, window: int = WINDOW, words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes of ``text`` removed, and what is left of the characters that they cut. Other columns stay.

    With ``words``, repeated passages of so many words go too. A null text stays null; a text without repeated bytes is
    unchanged; row order is not kept; repeated rows lose all of their text if it is long enough; an empty table stays empty.
    """
    with scratch(docs.sparkSession):
        found = repeated(docs, window, words=words, characters=True, passages_only=words > 0)
        changed = F.col("passages") if words else F.col("kept").cast("string")
        kept = stored(found.select("th", changed.alias("changed")), "kept-texts", keep=True)
    # The row travels as one struct, so its columns may have any names.
    keyed = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("th")).join(kept, "th", "left")
    return keyed.select(*[F.coalesce("changed", "row.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of strings of 400 bytes, and ``text``: what is left without repeated passages of over 50 words as well.

    Null and empty texts have no bytes; repeated rows each lose all of a text that is long enough.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark):
        told = repeated(docs, words=PASSAGE).select(
            "th",
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed"),
            F.size("spans").cast("long").alias("runs"),
            F.sha2("kept", 256).alias("left"),
            "passages",
        )
        told = stored(told, "repeated-digests", keep=True)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long"), text_key(F.col("text")).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("all"), text.alias("text"),
    )
    return own.join(told, "th", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.greatest(F.coalesce("runs", F.lit(0)), F.lit(0)).alias("n_spans"),
        F.coalesce("left", "all").alias("kept_sha256"),
        F.coalesce("passages", "text").alias("text"),
    )
