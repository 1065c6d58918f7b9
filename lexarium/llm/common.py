"""Helpers that the operators of this subpackage share: scratch tables, batch slicing, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.storage import lean_writes, scratch, shared_dir, stored

__all__ = ["batch", "components", "lean_writes", "rows_where", "scratch", "shared_dir", "slices", "stored", "table"]

#: Text bytes that a Python worker works on at once; bounds its memory whatever the batch holds.
SLICE_BYTES = 2 << 20
#: Rows of a batch that are texts of Python and a filtered copy at one time.
SLICE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def rows_where(df: DataFrame, keep) -> DataFrame:
    """Rows of ``df`` that ``keep(texts)`` (a list of booleans for a list of texts) holds for; all columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                texts = b.column("text").to_pylist()
                mask = [m for i, j in slices(texts) for m in keep(texts[i:j])]
                yield b.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as a stored table ``(node, component)``, component = smallest node.

    Alternates large-star and small-star contraction; every round pre-aggregates minima before it
    shuffles and is written to the shared folder, so a lost executor costs one round at most. The
    number of rounds grows with the logarithm of the longest path. Nulls and self-loops are ignored;
    no edges give no rows.
    """
    with scratch(edges.sparkSession):
        return stored(_contracted(edges), "components", keep=True)


def _contracted(edges: DataFrame) -> DataFrame:
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    before = digest(now)
    while before[0]:
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
