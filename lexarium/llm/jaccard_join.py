"""N-gram Jaccard join by PartEnum signatures, with exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.llm.common import components, scratch, slices, stored, table
from lexarium.llm.fingerprint import Ranges, mix

#: Words of a shingle and the similarity from which two sets link, in hundredths.
SHINGLE, PERCENT = 3, 90
#: Up to this many differing features PartEnum enumerates pairs of three sub-partitions (tolerating one
#: difference a partition); beyond, each partition is its own signature.
ENUMERATE_UP_TO = 8
#: Partitions for each one that the differences need: the more there are, the smaller is the share of them signed.
SPARE = 1.2
#: Signatures that a task holds, about, to find those that so many sets share that they leave the task once.
HELD, HOT = 1_000_000, 64
#: Features of a block of a group, about: what a task holds at most twice.
BLOCK_FEATURES = 1_000_000
SEED = np.uint64(0x5851F42D4C957F2D)

DOCS = "doc_id long, th long, n_shingles int, key long, sigs array<bigint>, hot array<bigint>, ties array<bigint>"
FEATURES = "key long, features array<bigint>"
LINKS = "a long, b long"


class Bands:
    """Size bands [low, high] with high = low * 100 / percent, and each band's PartEnum layout.

    Sets that link have sizes in one band or in two that follow each other, so a set has signatures for its own
    band and for the next. Two linked sets of together m features differ in at most
    floor(m * (100 - percent) / (100 + percent)) features.
    """

    def __init__(self, percent: int, largest: int):
        low, lows, highs = 1, [], []
        while not lows or highs[-1] < largest or len(lows) < 2:
            lows.append(low)
            highs.append(low * 100 // percent)
            low = highs[-1] + 1
        low, high = low, low * 100 // percent
        self.percent = percent
        self.lows = np.array([*lows, low])
        self.highs = np.array([*highs, high])
        differ = 2 * self.highs * (100 - percent) // (100 + percent)
        self.subsets = (differ > 0) & (differ <= ENUMERATE_UP_TO)
        #: Partitions: with sub-partitions one of them has at most one difference, without one has none.
        self.parts = np.ceil(SPARE * (np.where(self.subsets, differ // 2, differ) + 1)).astype(np.int64)
        self.cells = self.parts * np.where(self.subsets, 3, 1)

    def signed(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How many of a band's signatures a set of each size needs: none if no set of the band links with it.

        All sets of a band rank their signatures alike. Two that link share at least all but as many as their
        differences can break; with ``total`` signatures each of which ``shared`` are common, the first
        total - shared + 1 of either have one in common.
        """
        most = np.minimum(self.highs[band], sizes * 100 // self.percent)
        differ = (sizes + most) * (100 - self.percent) // (100 + self.percent)
        shared = self.parts[band] - np.where(self.subsets[band], differ // 2, differ)
        return np.where((differ > 0) & (most >= self.lows[band]), self.cells[band] - shared + 1, 0)


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> Bands:
    return Bands(percent, largest)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of word shingles as sorted 64-bit hashes.

    Words are what ASCII white space separates, A-Z lower-cased. A text with fewer than ``size`` words has its
    whole sequence as its only shingle; one without words has none.
    """
    raw = [t.encode().lower() if t else b"" for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) + 1
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1  # starts and ends of words by turns
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.empty(0, np.uint64)] * len(raw)
    h = mix(Ranges(data).raw(start, end) + (end - start).astype(np.uint64))
    of = np.searchsorted(ends, start, "right")
    counts = np.bincount(of, minlength=len(raw))
    n = len(h) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        rolled = mix(rolled + h[k : k + max(n, 0)])
    first = np.cumsum(counts) - counts
    out = []
    for i in range(len(raw)):
        if counts[i] >= size:
            out.append(np.unique(rolled[first[i] : first[i] + counts[i] - size + 1]))
        elif counts[i]:
            own = np.zeros(1, np.uint64)
            for x in h[first[i] : first[i] + counts[i]]:
                own = mix(own + x)
            out.append(mix(own + np.uint64(counts[i])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set, the same for equal sets."""
    out = np.empty(len(sets), np.uint64)
    for i, s in enumerate(sets):
        out[i] = mix(mix(s ^ SEED)).sum(dtype=np.uint64) + np.uint64(len(s)) if len(s) else 0
    return mix(out).view(np.int64)


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """PartEnum signatures of non-empty sets: different sets that link share at least one.

    Of a set's signatures those of the most features come first (equal ones by value), and only as many are given
    as linked sets need to share one: what a few features decide, as an empty partition, is left out.
    """
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    layout = bands(percent, 1 << int(sizes.max()).bit_length())
    features = np.concatenate(sets)
    own = np.searchsorted(layout.highs, sizes)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    value = mix(features + SEED)
    place = mix(features ^ SEED) >> np.uint64(32)
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    of = np.repeat(np.arange(len(sets)), sizes)
    for step in (0, 1):
        band = own + step
        need = layout.signed(sizes, band)
        cells = layout.cells[band]
        base = np.cumsum(cells) - cells
        cell = base[of] + (place * cells[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(cells.sum())
        # Sums modulo 2**64 of the features' values by cell; either half stays exact in a double.
        sums = np.bincount(cell, low, total).astype(np.uint64) + (np.bincount(cell, high, total).astype(np.uint64) << np.uint64(32))
        count = np.bincount(cell, minlength=total)
        number = (np.arange(total) - np.repeat(base, cells)).astype(np.uint64)
        tag = mix(np.repeat(band, cells).astype(np.uint64) * np.uint64(1 << 32) + number)
        triple = np.repeat(layout.subsets[band], cells)
        # A subset of two of three sub-partitions is named by the one that it leaves out.
        group = np.flatnonzero(triple).reshape(-1, 3)
        sums[group] = sums[group].sum(axis=1, dtype=np.uint64)[:, None] - sums[group]
        count[group] = count[group].sum(axis=1)[:, None] - count[group]
        sigs = mix(sums ^ tag)
        owner = np.repeat(np.arange(len(sets)), cells)
        order = np.lexsort((sigs, -count, owner))
        chosen = order[np.arange(total) - np.repeat(base, cells) < need[owner]]
        for i, s in enumerate(np.split(sigs[chosen].view(np.int64), np.cumsum(need)[:-1])):
            out[i].append(s)
    return [np.concatenate(x) for x in out]


def lists(parts: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)])
    values = np.concatenate([p for p in parts if p is not None] or [np.empty(0, np.int64)])
    mask = pa.array([p is None for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()), mask=mask)


def thinned(sigs: list[np.ndarray], keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Each set's signatures, without those that ``HOT`` of the sets or more share; of these, those that it is the first to have;
    and the keys of the sets that are the first with the others."""
    flat = np.concatenate(sigs)
    order = np.argsort(flat, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]])) if len(flat) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(flat)]]))
    many, first = np.empty(len(flat), bool), np.empty(len(flat), np.int64)
    many[order], first[order] = np.repeat(counts >= HOT, counts), np.repeat(order[new], counts)
    own = first == np.arange(len(flat))
    of = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
    ends = np.cumsum([len(s) for s in sigs])[:-1]
    cut = lambda x: np.split(x, ends)
    rare = [s[~m] for s, m in zip(sigs, cut(many), strict=True)]
    hot = [s[m & o] for s, m, o in zip(sigs, cut(many), cut(own), strict=True)]
    ties = [np.unique(keys[of[f[m & ~o]]]) for f, m, o in zip(cut(first), cut(many), cut(own), strict=True)]
    return rare, hot, ties


def sets_of(size: int, percent: int):
    """Every row's set size and key; signatures with the first row of each set that a task sees.

    A signature that ``HOT`` sets share leaves a task once for about ``HELD`` signatures, in ``hot``; the other sets are tied to
    the one that carries it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        count = 0

        def given() -> pa.RecordBatch:
            ids, th, sizes, keys, sigs = (
                [x for part in column for x in part] if k else pa.concat_arrays(list(column))
                for k, column in zip((0, 0, 1, 1, 1), zip(*held, strict=True), strict=True)
            )
            some = [k for k, x in enumerate(sigs) if x is not None]
            told = thinned([sigs[k] for k in some], np.array([keys[k] for k in some], np.int64)) if some else ((), (), ())
            hot: list[np.ndarray | None] = [None] * len(sigs)
            ties: list[np.ndarray | None] = [None] * len(sigs)
            for k, x, y, z in zip(some, *told, strict=True):
                sigs[k], hot[k], ties[k] = x, y, z
            arrays = [ids, th, pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), lists(sigs), lists(hot), lists(ties)]
            return pa.record_batch(arrays, names=["doc_id", "th", "n_shingles", "key", "sigs", "hot", "ties"])

        for b in batches:
            ids, th, texts = b.column("doc_id"), b.column("th"), b.column("text").to_pylist()
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], size)
                keys = set_keys(sets).tolist()
                fresh = []
                for k, (key, s) in enumerate(zip(keys, sets, strict=True)):
                    if len(s) and key not in seen:
                        seen.add(key)
                        fresh.append(k)
                sigs: list[np.ndarray | None] = [None] * (j - i)
                for k, s in zip(fresh, signatures([sets[k] for k in fresh], percent), strict=True):
                    sigs[k] = s
                    count += len(s)
                count += j - i
                keys = [k if len(s) else None for k, s in zip(keys, sets, strict=True)]
                held.append((ids.slice(i, j - i), th.slice(i, j - i), [len(s) for s in sets], keys, sigs))
                if count > HELD:
                    yield given()
                    held, count = [], 0
        if held:
            yield given()

    return run


def features_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], size)
                keys = set_keys(sets).tolist()
                new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
                yield pa.record_batch(
                    [pa.array([keys[k] for k in new], pa.int64()), lists([sets[k].view(np.int64) for k in new])],
                    names=["key", "features"],
                )

    return run


def links_within(keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all pairs (one of ``left``, one of ``right``) that link: a spanning forest of them.

    Exact: a pair is passed over if it is connected already (``parts`` says which sets are from the start), if the
    sizes rule it out, or if the parities of the features' counts by bin already differ more often than the
    two sets may.
    """
    sizes = np.array([len(x) for x in sets])
    bins = 1 << max(6, int(2 * sizes.max() - 1).bit_length())
    of = np.repeat(np.arange(len(sets)), sizes)
    at = (mix(np.concatenate(sets) + SEED) & np.uint64(bins - 1)).astype(np.int64)
    odd = np.empty((len(sets), bins // 64), np.uint64)
    step = max(1, (1 << 22) // bins)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, len(sets), step):
        j = min(len(sets), i + step)
        part = slice(starts[i], starts[j])
        counts = np.bincount((of[part] - i) * bins + at[part], minlength=(j - i) * bins)
        odd[i:j] = np.packbits((counts & 1).astype(np.uint8).reshape(j - i, bins), axis=1).view(np.uint64)
    root = np.arange(len(sets)) if parts is None else np.unique(parts, return_inverse=True)[1]
    out = []
    sizes_right = sizes[right]
    for x in left:
        n = sizes[x]
        near = right[(100 * np.minimum(n, sizes_right) >= percent * np.maximum(n, sizes_right)) & (right != x)]
        near = near[root[near] != root[x]]
        if not len(near):
            continue
        differ = np.bitwise_count(odd[near] ^ odd[x]).sum(axis=1, dtype=np.int64)
        for y in near[differ * (100 + percent) <= (n + sizes[near]) * (100 - percent)]:
            if root[x] == root[y]:
                continue
            place = np.searchsorted(sets[x], sets[y])
            place[place == n] = 0
            shared = int((sets[x][place] == sets[y]).sum())
            if 100 * shared >= percent * (n + sizes[y] - shared):
                out.append((int(keys[x]), int(keys[y])))
                root[root == root[y]] = root[x]
    return out


def compared(percent: int):
    """Links of each group (cluster, i, j): within block i if i = j, else between the two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def close() -> list[tuple[int, int]]:
            keys, block, parts = (np.array([h[k] for h in held]) for k in range(3))
            some = np.arange(len(held))
            left, right = (some, some) if group[1] == group[2] else (some[block == group[1]], some[block == group[2]])
            return links_within(keys, [h[3] for h in held], left, right, percent, parts) if len(left) and len(right) else []

        def given(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for b in batches:
            found = []
            sets = b.column("features")
            values, offsets = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            rows = zip(*(b.column(c).to_pylist() for c in ("cluster", "i", "j", "key", "block", "part")), strict=True)
            for r, (*own, key, block, part) in enumerate(rows):
                if own != group:
                    found += close() if held else []
                    group, held = own, []
                held.append((key, block, part, np.array(values[offsets[r] : offsets[r + 1]])))
            yield given(found)
        if held:
            yield given(close())

    return run


def within_groups(groups: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Links found in each group of rows ``(cluster, i, j, key, block, part)``."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.select("cluster", "i", "j", "key", "block", "part").join(features.hint("merge"), "key")
    groups = groups.select("cluster", "i", "j", "key", "block", "part", "features").repartition(n, "cluster", "i", "j")
    return groups.sortWithinPartitions("cluster", "i", "j", "key").mapInArrow(compared(percent), LINKS)


def dealt(members: DataFrame, by: list[str], block: str, parts: str) -> DataFrame:
    """``members(cluster, key, n, ...)`` with a block number for about every ``BLOCK_FEATURES`` of those alike in ``by``."""
    parted = members.groupBy(*by).agg(F.ceil(F.sum("n") / BLOCK_FEATURES).cast("int").alias(parts))
    return members.join(parted, by).withColumn(block, F.pmod(F.xxhash64("key"), F.col(parts)).cast("int"))


def pair(first: str, second: str) -> list:
    return [F.least(first, second).alias("i"), F.greatest(first, second).alias("j")]


def links_of(members: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that connect every two sets of a cluster that link; ``members(cluster, key, n)``, ``features(key, features)``.

    1. A cluster is dealt into blocks; sets are compared within each block.
    2. In a cluster of several blocks the first set of each group found so far stands for it; those are compared
       across all blocks.
    3. The other sets are compared with all sets outside their group, but not the largest group's with each other: near
       copies cost what they are, not their square.
    """
    blocks = stored(dealt(members, ["cluster"], "block", "blocks"), "cluster-blocks")
    alone = blocks.withColumn("part", F.col("key")).withColumn("i", F.col("block")).withColumn("j", F.col("block"))
    links = stored(within_groups(alone, features, percent), "links")
    large = blocks.where("blocks > 1").select("cluster", "key", "n")
    if large.isEmpty():
        return links
    inside = large.select("key").distinct()

    def parted() -> DataFrame:
        own = links.join(inside.withColumnRenamed("key", "a"), "a", "left_semi")
        found = components(own).select(F.col("node").alias("key"), F.col("component").alias("part"))
        return stored(large.join(found, "key", "left").withColumn("part", F.coalesce("part", "key")), "cluster-parts")

    # 2: one set of each group of a cluster; every two blocks of them meet
    before = parted()
    first = before.groupBy("cluster", "part").agg(F.min(F.struct("key", "n")).alias("x")).select("cluster", "part", "x.*")
    first = stored(first, "cluster-firsts")
    across = dealt(first, ["cluster"], "block", "blocks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = stored(links.union(within_groups(across.select("*", *pair("block", "other")), features, percent)), "links")
    # 3: kinds of sets: outside the largest group and not compared yet, outside and compared, inside and not, inside and compared
    now = parted().join(first.select("cluster", "key", F.lit(True).alias("met")), ["cluster", "key"], "left")
    sizes = now.groupBy("cluster", "part").agg(F.sum("n").alias("total"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("total", "part")).alias("most"))
    now = now.join(largest.select("cluster", F.col("most.part").alias("largest")), "cluster")
    kind = F.when(F.col("part") == F.col("largest"), 2).otherwise(0) + F.when(F.col("met"), 1).otherwise(0)
    now = now.withColumn("kind", kind).drop("largest", "met")
    counts = now.groupBy("cluster").agg(
        *[F.ceil(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) / BLOCK_FEATURES).cast("int").alias(f"q{k}") for k in range(4)]
    )
    now = now.join(counts.where("q0 > 0 or (q1 > 0 and q2 > 0)"), "cluster")
    # Blocks of each kind follow each other; which kinds meet which.
    starts = [F.lit(0), F.col("q0"), F.col("q0") + F.col("q1"), F.col("q0") + F.col("q1") + F.col("q2")]
    span = lambda k: F.when(F.col(f"q{k}") > 0, F.sequence(starts[k], starts[k] + F.col(f"q{k}") - 1)).otherwise(F.array().cast("array<int>"))
    meets = ((0, 1, 2, 3), (0, 2), (0, 1), (0,))
    block, other = F.lit(None).cast("int"), F.lit(None).cast("array<int>")
    for k in range(4):
        mine = F.col("kind") == k
        block = F.when(mine, starts[k] + F.pmod(F.xxhash64("key"), F.greatest(F.col(f"q{k}"), F.lit(1))).cast("int")).otherwise(block)
        other = F.when(mine, F.concat(*[span(m) for m in meets[k]])).otherwise(other)
    across = now.withColumn("block", block.cast("int")).withColumn("other", F.explode(other))
    return stored(links.union(within_groups(across.select("*", *pair("block", "other")), features, percent)), "links")


def similar_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Sets of all documents, and the components of distinct sets that link.

    Returns ``(doc_id, n_shingles, key)`` by document (key null for an empty set) and ``(key, component)`` for the
    sets that link with another. The sets that share a signature are compared in the group of the smallest of them, so sets
    that collide by chance cost a comparison and no more; a signature that very many sets share joins them to
    clusters instead. ``links_of`` compares groups and clusters, exactly; no pairs are ever listed.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    row_id = F.coalesce("doc_id", F.lit(-1))
    sets = stored(rows.mapInArrow(sets_of(size, percent), DOCS), "shingle-sets")
    signed = sets.where("size(sigs) > 0").select("key", F.explode("sigs").alias("sig"), F.lit(False).alias("hot"))
    signed = signed.union(sets.where("size(hot) > 0").select("key", F.explode("hot").alias("sig"), F.lit(True).alias("hot")))
    same = Window.partitionBy("sig")
    shared = signed.withColumn("low", F.min("key").over(same)).withColumn("hot", F.max("hot").over(same)).where("key <> low")
    shared = stored(shared.select("low", "key", "hot").distinct(), "shared-signatures")
    ties = sets.where("size(ties) > 0").select("key", F.explode("ties").alias("b"))
    clusters = components(shared.where("hot").select(F.col("low").alias("a"), F.col("key").alias("b")).union(ties))
    groups = shared.where("not hot").select(F.col("low").alias("cluster"), "key")
    groups = groups.union(groups.select("cluster", F.col("cluster").alias("key"))).union(clusters.select("component", "node")).distinct()
    # One row a set before any join, so that a set that many documents share meets no task as a group.
    own = sets.where("key is not null").groupBy("key").agg(F.min(F.struct("th", row_id.alias("d"))).alias("at"), F.first("n_shingles").alias("n"))
    members = stored(groups.join(own.select("key", "at.*", "n"), "key"), "cluster-members")
    # Texts of the sets in question: one for each, found again by its hash and row. The join is the same at every size.
    texts = rows.select("th", row_id.alias("d"), "text").join(members.select("th", "d").distinct().hint("merge"), ["th", "d"], "left_semi").select("text")
    features = stored(texts.mapInArrow(features_of(size), FEATURES).dropDuplicates(["key"]), "set-features")
    links = links_of(members.select("cluster", "key", "n"), features, percent)
    return sets.select("doc_id", "n_shingles", "key"), components(links).select(F.col("node").alias("key"), "component")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Documents with the component of their shingle set.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, n_shingles, component_id``
    (smallest doc_id that links reach, the document's own included). Null and empty texts have no shingles and
    stand alone. Equal sets always link. Repeated rows are kept; an empty table gives no rows. Sets are told
    apart by 64-bit keys.
    """
    size_of = F.col("n_shingles").cast("long").alias("n_shingles")
    with scratch(docs.sparkSession):
        sets, groups = similar_sets(docs, size, percent)
        # By distinct set first, so a set that many documents share is one row until the last join.
        own = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
        own = own.join(groups, "key", "left")
        told = own.groupBy(F.coalesce("component", "key").alias("c")).agg(F.min("low").alias("component_id"), F.sum("n").alias("total"))
        many = own.select("key", F.coalesce("component", "key").alias("c")).join(told.where("total > 1"), "c")
        linked = sets.where("key is not null").join(many.select("key", "component_id"), "key", "left")
        linked = linked.select("doc_id", size_of, F.coalesce("component_id", "doc_id").alias("component_id"))
        alone = sets.where("key is null").select("doc_id", size_of, F.col("doc_id").alias("component_id"))
        return stored(linked.union(alone), "jaccard-components", keep=True)


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, with all columns, but for those that link, directly or not, with a smaller doc_id.

    Rows without an id stay. Rows that repeat a doc_id stay or go together.
    """
    with scratch(docs.sparkSession):
        found = jaccard_components(docs, size, percent).where("component_id < doc_id").select("doc_id").distinct()
        found = stored(found, "near-copies", keep=True)
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at three words and 0.9; null and empty texts stand alone; equal sets link; repeated rows are kept."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: DuckDB form of the query: exact, by a join of all shingles, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
  ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
u AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM u a JOIN u b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, e.b FROM reach r JOIN near e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(low, doc_id) AS component_id FROM n LEFT JOIN low USING (doc_id)"""
