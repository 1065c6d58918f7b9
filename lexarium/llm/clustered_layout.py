"""Multidimensional clustered layout: equal-share coordinates, files along a z-order curve, files that a row's query meets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.llm.common import scratch, stored, table

#: Binary digits of a coordinate: 16 coordinates a dimension.
DIGITS = 4
FILE_ROWS = 500
#: How far a query reaches on each side, in coordinates; also the order of ``file_bounds``.
REACH = {"source": 0, "lang": 0, "length": 2, "date": 2}
#: The order in which a round of interleaving takes one digit of each coordinate.
ROUND = ("length", "source", "date", "lang")
#: ``monotonically_increasing_id`` holds the task above these bits and the row's place in it below.
PLACE_BITS = 33


def interleaved(named: Mapping[str, str], order: Sequence[str]) -> Column:
    """The binary digits of the coordinates in the columns ``named`` by dimension, highest first, one of each dimension a round."""
    digits = [(d, bit) for bit in range(DIGITS) for d in order[::-1]]
    return F.expr(" + ".join(f"(shiftright({named[d]}, {bit}) & 1) * {1 << k}" for k, (d, bit) in enumerate(digits))).cast("int")


def coordinate_in(z: str, dimension: str, order: Sequence[str]) -> Column:
    """The coordinate of a dimension that ``interleaved`` put into the column ``z``."""
    at = [(DIGITS - 1 - r) * len(order) + len(order) - 1 - list(order).index(dimension) for r in range(DIGITS)]
    return F.expr(" + ".join(f"(shiftright({z}, {bit}) & 1) * {1 << k}" for k, bit in enumerate(at[::-1]))).cast("int")


def cuts(values: DataFrame, dimensions: Sequence[str]) -> dict[str, list[tuple[int, object]]]:
    """Of each dimension, its occupied coordinates with the smallest value of each: at most 16 a dimension.

    Equal values are one row before anything is sorted. Sums over the values before a value come in two steps: values are dealt
    to ranges, written (so that a range stays what it is when a task runs again), summed by range, and then within their range.
    """
    texts = {name for name, kind in values.dtypes if kind == "string"}
    one = [
        F.struct(
            F.lit(i).alias("dim"),
            (F.col(d) if d in texts else F.lit(None).cast("string")).alias("word"),
            (F.lit(None).cast("long") if d in texts else F.col(d).cast("long")).alias("number"),
        )
        for i, d in enumerate(dimensions)
    ]
    counts = values.select(F.explode(F.array(*one)).alias("v")).groupBy("v.dim", "v.word", "v.number").agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange("dim", "word", "number").withColumn("part", F.spark_partition_id()), "layout-values")
    ranges = dealt.groupBy("dim", "part").agg(F.sum("n").alias("n"))
    by_range = Window.partitionBy("dim").orderBy("part")
    ranges = ranges.select(
        "dim",
        "part",
        F.coalesce(F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("n").over(Window.partitionBy("dim")).alias("all"),
    )
    inside = Window.partitionBy("dim", "part").orderBy("word", "number").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ranges), ["dim", "part"])
    coordinate = F.expr(f"({1 << DIGITS} * (below + inside)) div all").cast("int")
    first = ranked.groupBy("dim", coordinate.alias("c")).agg(F.min(F.struct("word", "number")).alias("v"))
    found: dict[str, list] = {d: [] for d in dimensions}
    for row in sorted(first.collect(), key=lambda r: (r.dim, r.c)):
        found[dimensions[row.dim]].append((row.c, row.v.word if dimensions[row.dim] in texts else row.v.number))
    return found


def coordinate_of(value: Column, at: Sequence[tuple[int, object]]) -> Column:
    """The coordinate of a value by the cuts of its dimension; null has the first."""
    return reduce(lambda below, cut: F.when(value >= F.lit(cut[1]), cut[0]).otherwise(below), at[1:], F.lit(0)).cast("int")


def in_order(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows sorted over the whole table, with ``task`` and ``place``, and the rows before each task (one row a task).

    A further key spreads rows of equal keys over several ranges. What is written is read as it is afterwards: places hold.
    """
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    number = F.monotonically_increasing_id()
    kept = stored(dealt.withColumn("number", number), "layout-rows")
    kept = kept.withColumn("task", F.shiftright("number", PLACE_BITS).cast("int")).withColumn("place", F.col("number").bitwiseAND((1 << PLACE_BITS) - 1))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = kept.groupBy("task").agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return kept.drop("number"), tasks


def clustered(rows: DataFrame, reach: Mapping[str, int], order: Sequence[str], key: str = "doc_id", file_rows: int = FILE_ROWS) -> DataFrame:
    """Lay ``rows`` out in files along a z-order curve, and tell of each row how many files its query touches.

    ``rows`` needs ``key`` and a column for each dimension of ``reach`` (strings compare by their UTF-8 bytes, others as whole
    numbers; null is the smallest value); further columns are ignored. A value's coordinate is its share of smaller rows, in
    sixteenths. Files take ``file_rows`` rows each in order of ``z``, then ``key`` (null first). A row's query is the box of
    coordinates at most ``reach`` from its own. Returns ``key, z, position, file, files_touched`` (files whose bounds meet the
    query), ``files_matching`` (files that hold a row inside it) and ``file_bounds`` as a stored table. Repeated rows keep a
    position each; equal keys at one place of the curve take theirs in any order, which no other column can tell. An empty table
    gives no rows.

    The curve has at most 16 ** dimensions cells, whatever the table's size, and a file holds a stretch of it, so there are at most
    as many (cell, file) pairs as cells and files together. Each pair is scattered to the cells whose query holds it, each file's
    bounds, widened by ``reach``, to the cells inside; both are counted by cell, and nothing is joined by ranges. Boxes of files
    that meet a boundary of the curve at its k-th digit are no larger than the block between two such boundaries, so
    the boxes of all files hold no more cells than a block of the whole curve a digit, besides the widening.
    """
    spark = rows.sparkSession
    dims = list(reach)
    with scratch(spark):
        values = stored(rows.select(F.col(key).alias("key"), *dims), "layout-columns")
        at = cuts(values, dims)
        # ``or``: an empty table has no cuts.
        coordinates = values.select("key", *(coordinate_of(F.col(d), at[d] or [(0, None)]).alias(d) for d in dims))
        kept, tasks = in_order(coordinates.select("key", interleaved({d: f"`{d}`" for d in dims}, order).alias("z")), ["z", "key"])
        position = F.col("before") + F.col("place")
        placed = kept.join(F.broadcast(tasks), "task").select("key", "z", position.alias("position"), F.expr(f"(before + place) div {file_rows}").alias("file"))
        cell_files = stored(placed.select("z", "file").distinct(), "layout-cell-files")
        coordinate = {d: coordinate_in("z", d, order) for d in dims}
        files = cell_files.groupBy("file").agg(*(f(coordinate[d]).alias(f"{side}_{d}") for d in dims for side, f in (("low", F.min), ("high", F.max))))
        cells = cell_files.select("z").distinct()
        within = spread_over(cell_files.select("file", *(coordinate[d].alias(d) for d in dims)), {d: (d, d) for d in dims}, at, reach, order)
        matching = within.distinct().groupBy("z").agg(F.count("*").alias("files_matching"))
        boxes = spread_over(files, {d: (f"low_{d}", f"high_{d}") for d in dims}, at, reach, order)
        touched = boxes.groupBy("z").agg(F.count("*").alias("files_touched"))
        by_cell = cells.join(matching, "z").join(touched, "z")
        bounds = files.select("file", F.concat_ws(",", *(F.col(f"{side}_{d}") for d in dims for side in ("low", "high"))).alias("file_bounds"))
        # At most 16 ** dimensions rows go along with every task; files are as many as the input asks for and are shuffled.
        done = placed.join(F.broadcast(by_cell), "z").join(bounds.hint("shuffle_hash"), "file")
        return stored(
            done.select(F.col("key").alias(key), *(F.col(c).cast("long") for c in ("z", "position", "file", "files_touched", "files_matching")), "file_bounds"),
            "clustered-layout",
            keep=True,
        )


def spread_over(boxes: DataFrame, sides: Mapping[str, tuple[str, str]], at: Mapping[str, list], reach: Mapping[str, int], order: Sequence[str]) -> DataFrame:
    """``(z, file)`` of every cell of each box, widened by ``reach``, over the coordinates that occur at all."""

    def side(d: str) -> Column:
        low, high = (F.col(c) for c in sides[d])
        there = F.array(*(F.lit(c) for c, _ in at[d])) if at[d] else F.array().cast("array<int>")
        return F.explode(F.filter(there, lambda c: c.between(low - reach[d], high + reach[d])))

    for d in sides:
        boxes = boxes.withColumn(f"at_{d}", side(d))
    return boxes.select(interleaved({d: f"`at_{d}`" for d in sides}, order).alias("z"), "file")


def document_dimensions(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the four values that documents are laid out by."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("length"),
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 365).alias("date"),
    )


def op11_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document on the curve, its file, and the files that its query touches and that hold matches.

    Null source, lang or doc_id (whose date is null then) count as the smallest value, a null text as length -1; repeated rows keep a
    position each; other columns are not read; an empty table gives no rows.
    """
    return clustered(document_dimensions(table(spark, sf_dir, "documents")), REACH, ROUND)


def oracle() -> str:
    """DuckDB form: ranks and positions by windows, files by range joins over their bounds."""

    def digits(d: str) -> str:
        return " + ".join(f"(({d} >> {bit}) & 1) * {1 << (bit * len(ROUND) + len(ROUND) - 1 - ROUND.index(d))}" for bit in range(DIGITS))

    share = ", ".join(f"({1 << DIGITS} * (rank() OVER (ORDER BY {d} NULLS FIRST) - 1)) // count(*) OVER () AS {d}" for d in REACH)
    sides = ", ".join(f"min({d}) AS low_{d}, max({d}) AS high_{d}" for d in REACH)
    bounds = " || ',' || ".join(f"low_{d} || ',' || high_{d}" for d in REACH)
    meets = " AND ".join(f"f.high_{d} >= c.{d} - {r} AND f.low_{d} <= c.{d} + {r}" for d, r in REACH.items())
    holds = " AND ".join(f"m.{d} BETWEEN c.{d} - {r} AND c.{d} + {r}" for d, r in REACH.items())
    return f"""
WITH bytes AS (SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b FROM documents),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
                                  lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295) AS code FROM bytes),
vals AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length, code % 365 AS date FROM crc),
coords AS (SELECT doc_id, {share} FROM vals),
curve AS (SELECT *, {' + '.join(digits(d) for d in ROUND)} AS z FROM coords),
placed AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM curve),
filed AS (SELECT *, position // {FILE_ROWS} AS file FROM placed),
files AS (SELECT file, {sides} FROM filed GROUP BY file),
cells AS (SELECT DISTINCT z, {', '.join(REACH)} FROM filed),
pairs AS (SELECT DISTINCT file, z, {', '.join(REACH)} FROM filed),
touched AS (SELECT c.z, count(*) AS files_touched FROM cells c JOIN files f ON {meets} GROUP BY c.z),
matching AS (SELECT c.z, count(DISTINCT m.file) AS files_matching FROM cells c JOIN pairs m ON {holds} GROUP BY c.z)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched::BIGINT AS files_touched,
       files_matching::BIGINT AS files_matching, {bounds} AS file_bounds
FROM filed JOIN files USING (file) JOIN touched USING (z) JOIN matching USING (z)"""
