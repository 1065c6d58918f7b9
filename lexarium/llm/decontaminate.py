"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Windows that cannot lie within the edit limit are ruled out first, without loss: an item is cut into pieces, and
with d edits all but d of them occur unchanged, their places shifted against each other by at most d. A window
around such places is embedded by the CGK random walk, which maps edit distance to Hamming distance; repeated
bit sampling of the embedding decides by collision whether the exact edit distance is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import rows_where, slices, stored, table

#: Edits allowed, as a share of an item's bytes; shorter items than MIN_BYTES must occur as they are.
EDIT_RATE, MIN_BYTES = 0.1, 24
#: Bytes of a piece; those of an item that is too short for one more of these than edits are shorter.
PIECE = 8
#: LSH: sampled places a table, walks (random functions), recall aimed at, and the share of embedded places at
#: which a window at the edit limit still agrees with its item (measured by the tests, rounded down).
SAMPLED, WALKS, RECALL, AGREEMENT = 5, 6, 0.999, 0.43
TABLES = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT**SAMPLED) / WALKS)
#: Items held by a task at once; a larger benchmark is done in blocks of about so many.
ITEM_BLOCK = 4000
#: Windows embedded at once.
WINDOWS = 2048

OUT = "doc_id long, item_id long, start int, distance int, item_bytes int"


def normal(text: str | None) -> bytes:
    """Lower case, white space runs as one space, none at the ends; UTF-8."""
    return b" ".join((text or "").lower().encode().split())


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    n = len(data) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for s in range(min(8, n)):
        part = np.frombuffer(data[s : s + (n - s + 7) // 8 * 8].tobytes(), "<u8")
        out[s::8] = part[: len(out[s::8])]
    return out


@lru_cache(maxsize=256)
def walk_bits(top: int, walk: int) -> np.ndarray:
    """For each step and byte whether the walk moves on; the same for an item and its windows."""
    return np.random.default_rng([top, walk]).integers(0, 2, (3 * top, 257), dtype=np.uint8)


def embed(strings: np.ndarray, walk: int) -> np.ndarray:
    """CGK: at each of 3n steps a string gives the byte it stands at and moves on by a random bit of it.

    ``strings`` is (count, n) of bytes, 256 past a string's end; returns (3n, count).
    """
    count, n = strings.shape
    padded = np.concatenate([strings, np.full((count, 1), 256, np.int16)], axis=1).ravel()
    bits = walk_bits(n, walk)
    at = np.arange(count) * (n + 1)
    end = at + n
    out = np.empty((3 * n, count), np.int16)
    for step in range(3 * n):
        c = padded[at]
        out[step] = c
        at = np.minimum(at + bits[step][c], end)
    return out


def padded(strings: list[bytes], top: int) -> np.ndarray:
    out = np.full((len(strings), top), 256, np.int16)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out


def edit_distance_within(item: bytes, text: bytes) -> tuple[int, int]:
    """(smallest edit distance of the item to a substring of ``text``, where that substring ends)."""
    n = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = mask, 0, n
    best, end = n, 0
    for at, c in enumerate(text):  # bit-parallel columns; the first row is 0 everywhere
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Pieces:
    """Pieces of one size, found in a text all at once: rows (bytes as a number, item, offset in the item)."""

    def __init__(self, size: int, rows: list[tuple[int, int, int]]):
        piece, of, offset = (np.array(x, np.uint64 if k == 0 else np.int64) for k, x in enumerate(zip(*rows, strict=True)))
        order = np.argsort(piece, kind="stable")
        self.mask = np.uint64((1 << 8 * size) - 1)
        self.of, self.offset = of[order], offset[order]
        self.values, self.first, self.count = np.unique(piece[order], return_index=True, return_counts=True)
        self.slots = np.zeros(1 << 20, bool)
        self.slots[self.slot(self.values)] = True

    @staticmethod
    def slot(v: np.ndarray) -> np.ndarray:
        return (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset) of all pieces in ``data``, the bytes from each position on as numbers."""
        v = data & self.mask
        at = np.flatnonzero(self.slots[self.slot(v)])
        place = np.minimum(np.searchsorted(self.values, v[at]), len(self.values) - 1)
        exact = self.values[place] == v[at]
        at, place = at[exact], place[exact]
        count = self.count[place]
        row = np.repeat(self.first[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(at, count), self.of[row], self.offset[row]


class Benchmark:
    """Items with the pieces that lead to their windows."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = EDIT_RATE):
        self.ids, self.items, self.edits = [], [], []
        seen = set()
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            item = normal(text)
            if item and (item_id, item) not in seen:
                seen.add((item_id, item))
                self.ids.append(item_id)
                self.items.append(item)
                self.edits.append(int(rate * len(item)) if len(item) >= MIN_BYTES else 0)
        self.short = [k for k, x in enumerate(self.items) if len(x) < PIECE]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        self.need = np.ones(len(self.items), np.int64)
        for k, (item, d) in enumerate(zip(self.items, self.edits, strict=True)):
            if len(item) < PIECE:
                continue
            # At least d + 1 pieces that don't overlap, so that an edit breaks one: of m pieces m - d occur unchanged.
            size = min(PIECE, len(item) // (d + 1))
            starts = range(0, len(item) - size + 1, size)
            self.need[k] = len(starts) - d
            pieces.setdefault(size, []).extend((int.from_bytes(item[s : s + size], "little"), k, s) for s in starts)
        #: By size of the pieces: their bytes as numbers, in order.
        self.pieces = {size: Pieces(size, rows) for size, rows in pieces.items()}
        #: Items by length class: walks are shared by a class, sampled places lie within 3 x an item's length.
        self.top = np.array([-(-len(x) // 64) * 64 for x in self.items], np.int64)
        self.places = np.zeros((WALKS, len(self.items), TABLES, SAMPLED), np.int64)
        self.sampled = np.zeros((WALKS, len(self.items), TABLES, SAMPLED), np.int16)
        for top in np.unique(self.top):
            own = np.flatnonzero(self.top == top)
            strings = padded([self.items[k] for k in own], top)
            for walk in range(WALKS):
                e = embed(strings, walk)
                for i, k in enumerate(own):
                    n = len(self.items[k])
                    self.places[walk, k] = np.random.default_rng([7, n, walk]).integers(0, 3 * n, (TABLES, SAMPLED))
                    self.sampled[walk, k] = e[self.places[walk, k], i]

    def collide(self, windows: list[bytes], item: np.ndarray) -> np.ndarray:
        """Which windows share all sampled places of a table with their item, under any walk."""
        hit = np.zeros(len(windows), bool)
        top = self.top[item]
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            for i in range(0, len(rows), WINDOWS):
                part = rows[i : i + WINDOWS]
                strings = padded([windows[r] for r in part], t)
                for walk in range(WALKS):
                    left = np.flatnonzero(~hit[part])
                    if not len(left):
                        break
                    e = embed(strings[left], walk)
                    k = item[part[left]]
                    same = e[self.places[walk, k], np.arange(len(left))[:, None, None]] == self.sampled[walk, k]
                    hit[part[left]] |= same.all(axis=2).any(axis=1)
        return hit

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, window start) of all windows that pieces do not rule out."""
        # Zeros at the end: pieces shorter than eight bytes occur up to a text's last byte.
        data = octets(np.frombuffer(b"\0".join(texts) + bytes(PIECE), np.uint8))
        found = [p.places(data) for p in self.pieces.values()] or [(np.empty(0, np.int64),) * 3]
        at, item, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        diagonal = at - offset
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        # A window needs as many pieces on diagonals that lie within its edits.
        edits = np.array(self.edits, np.int64)[item] if len(item) else item
        last = np.arange(len(item)) + self.need[item] - 1
        inside = last < len(item)
        far = np.minimum(last, len(item) - 1)
        ok = inside & (text[far] == text) & (item[far] == item) & (diagonal[far] - diagonal <= edits)
        # All diagonals of such a run are starts to try.
        mark = np.zeros(len(item) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(ok), 1)
        np.add.at(mark, far[ok] + 1, -1)
        keep = np.cumsum(mark)[:-1] > 0
        text, item, start = text[keep], item[keep], (diagonal - begin[text])[keep]
        if len(text):
            once = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])])
            text, item, start = text[once], item[once], start[once]
        return text, item, start

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, start, distance) of the best occurrence of each item found in each text."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        text, item, start = self.candidates(texts)
        sizes = [len(self.items[k]) for k in item]
        lows = [min(max(0, int(p)), max(0, len(texts[t]) - n)) for t, p, n in zip(text, start, sizes, strict=True)]
        windows = [texts[t][p : p + n] for t, p, n in zip(text, lows, sizes, strict=True)]
        whole = np.array([self.items[k] == w for k, w in zip(item, windows, strict=True)], bool)
        for r in np.flatnonzero(whole):
            key = (int(text[r]), int(item[r]))
            best[key] = min(best.get(key, (0, lows[r])), (0, lows[r]))
        done = np.array([(int(t), int(k)) in best for t, k in zip(text, item, strict=True)], bool)
        rest = np.flatnonzero(~done)
        hit = self.collide([windows[r] for r in rest], item[rest]) if len(rest) else []
        # Colliding windows that overlap are verified together; rows are in order of text, item and start.
        spans: list[list[int]] = []
        for r in rest[hit] if len(rest) else []:
            t, k, low = int(text[r]), int(item[r]), lows[r]
            if spans and spans[-1][:2] == [t, k] and low <= spans[-1][3] <= spans[-1][2] + 8 * sizes[r]:
                spans[-1][3] = low + sizes[r]
            else:
                spans.append([t, k, low, low + sizes[r]])
        for t, k, low, high in spans:
            d, n = self.edits[k], len(self.items[k])
            lo = max(0, low - d)
            distance, end = edit_distance_within(self.items[k], texts[t][lo : high + d])
            found = (distance, max(0, lo + end - n))
            if distance <= d and found < best.get((t, k), (n, 0)):
                best[t, k] = found
        for k in self.short:
            for i, t in enumerate(texts):
                if (p := t.find(self.items[k])) >= 0:
                    best[i, k] = (0, p)
        return [(i, k, p, distance) for (i, k), (distance, p) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """Pairs of a document and a benchmark item that occurs in it within ``rate`` edits a byte.

    ``docs`` needs ``doc_id, text``, ``benchmark`` ``item_id, text``; other columns are ignored. Both are compared in
    lower case with white space runs as one space. Returns ``doc_id, item_id, start`` (about, in bytes of that
    form), ``distance`` (smallest edit distance) and ``item_bytes``, one row for each row of ``docs`` and item. Null and
    empty texts and items match nothing; items of fewer than ``MIN_BYTES`` bytes must occur unchanged; repeated
    rows of ``docs`` repeat their pairs, repeated items count once. Driver and tasks hold one block of about ``ITEM_BLOCK``
    items; a larger benchmark is done block by block, each block's pairs written before the next is read.
    """
    out = None
    for block, more in item_blocks(benchmark):
        found = _scan(docs, block, rate)
        if more or out is not None:
            found = stored(found, "benchmark-pairs")
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], OUT) if out is None else out


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """The non-null items in blocks of about ``ITEM_BLOCK``, read one by one, and whether another block follows."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    blocks = -(-items.count() // ITEM_BLOCK)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for k in range(blocks):
        yield [tuple(r) for r in items.where(place == k).collect()], k + 1 < blocks


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """Rows of ``docs``, with all columns, in which no item occurs within ``rate`` edits a byte.

    A row with a null or empty text stays; rows that repeat a text stay or go together; an empty benchmark keeps all rows.
    """
    for block, more in item_blocks(benchmark):
        docs = rows_where(docs, _clean(block, rate))
        if more:
            docs = stored(docs, "without-items")
    return docs


def _clean(items: list[tuple], rate: float):
    def keep(texts: list[str | None]) -> list[bool]:
        found = {t for t, *_ in worker_benchmark(items, rate).find([normal(x) for x in texts])}
        return [i not in found for i in range(len(texts))]

    return keep


_built: dict[tuple, Benchmark] = {}


def worker_benchmark(items: list[tuple], rate: float) -> Benchmark:
    name = (hash(tuple(items)), len(items), rate)
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(items, rate)
    return _built[name]


def _scan(docs: DataFrame, items: list[tuple], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_benchmark(items, rate)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            out: list[tuple] = []
            for i, j in slices(texts):
                for t, k, p, distance in held.find([normal(x) for x in texts[i:j]]):
                    out.append((ids[i + t], held.ids[k], p, distance, len(held.items[k])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start", "distance", "item_bytes"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(run, OUT)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item in it; null and empty texts and items match nothing; repeated rows repeat pairs."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
