"""Dense top-k, exactly, over partitions around centres: bounds leave partitions out before their vectors are read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.operators.lexical import best_first
from lexarium.storage import stored

#: Rows that centres are fitted on at most, centres at most, rounds of the fit.
FIT_ROWS, CENTRES, ROUNDS = 20_000, 1024, 5
#: Vectors of a cell and queries of a block that a task holds at once, about.
CELL, BLOCK = 4096, 4096
#: Scores are rounded to six digits: what may still tie with the last place.
SLACK = 2e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@dataclass
class VectorIndex:
    """Vectors by partition and cell; a partition's centre, and how far from it its vectors are at most.

    A cell holds the vectors of a partition at a like distance from its centre: rings bound their scores more closely, and many equal vectors
    are several cells.
    """

    vectors: DataFrame  # part, ring, slot, doc_id, embedding
    cells: DataFrame  # part, ring, slot, n, far: the largest distance from the centre
    centres: DataFrame  # part, centre

    @classmethod
    def build(cls, vectors: DataFrame) -> VectorIndex:
        """From ``(doc_id, embedding)``; rows without either are left out.

        Centres are fitted on a sample of at most about ``FIT_ROWS`` rows, chosen by a hash of their id; every row is put to its nearest
        centre. There are about as many centres as the square root of the rows, ``CENTRES`` at most.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = stored(vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "embedding"), "vector-rows")
        n = rows.count()
        k = max(2, min(CENTRES, round(n**0.5)))
        one_in = n // FIT_ROWS + 1
        sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
        fitted = KMeans(k=k, maxIter=ROUNDS, seed=1, initMode="random").fit(sample.select(array_to_vector("embedding").alias("features"))) if n else None
        held = [(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())] if n else []
        centres = stored(rows.sparkSession.createDataFrame(held, "part int, centre array<double>"), "vector-centres")
        matrix = np.array([c for _, c in held])

        @F.pandas_udf("part int, far double")
        def nearest(e: pd.Series) -> pd.DataFrame:
            x = np.stack(e.to_numpy()).astype(np.float64) if len(e) else np.zeros((0, matrix.shape[1]))
            part, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), 512):
                d = distances(x[i : i + 512], matrix)
                part[i : i + 512], far[i : i + 512] = d.argmin(axis=1), d.min(axis=1)
            return pd.DataFrame({"part": part, "far": far})

        placed = rows.withColumn("p", nearest("embedding")).select("p.*", "doc_id", "embedding") if n else rows.select(F.lit(0).alias("part"), F.lit(0.0).alias("far"), "doc_id", "embedding")
        # Rings by tenths of the largest distance, slots by the id: neither grows beyond a few thousand vectors.
        placed = stored(placed, "vector-places")
        most = placed.agg(F.max("far")).first()[0] or 1.0
        sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
        ring = F.floor(F.col("far") / most * 8).cast("int")
        slot = F.pmod(F.xxhash64("doc_id"), F.floor(F.col("size") / CELL) + 1).cast("int")
        kept = stored(placed.join(F.broadcast(sizes), "part").select("part", ring.alias("ring"), slot.alias("slot"), "far", "doc_id", "embedding"), "vector-cells")
        cells = stored(kept.groupBy("part", "ring", "slot").agg(F.count("*").alias("n"), F.max("far").alias("far")), "vector-bounds")
        return cls(kept.drop("far"), cells, centres)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def bounded(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, embedding, block, part, ring, slot, n, bound)``: no vector of a cell has a larger dot product with the query.

    q.x = q.c + q.(x - c), and the last is at most the query's length times the distance of x from the centre c.
    """
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // BLOCK))
    # Centres are at most CENTRES rows: one row of them goes along with the queries.
    every = index.centres.agg(F.collect_list(F.struct("part", "centre")).alias("centres"))
    near = asked.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "size": norm(F.col("embedding"))}).join(F.broadcast(every))
    near = near.select("query_id", "embedding", "block", "size", F.explode("centres").alias("c")).select("*", "c.part", dot(F.col("embedding"), F.col("c.centre")).alias("middle"))
    return near.join(index.cells, "part").select("query_id", "embedding", "block", "part", "ring", "slot", "n", (F.col("middle") + F.col("size") * F.col("far")).alias("bound"))


def scored(index: VectorIndex, wanted: DataFrame, k: int) -> DataFrame:
    """Of each wanted cell the ``k`` best vectors for each query that wants it."""
    at = ["part", "ring", "slot", "block"]
    routes = wanted.select(*(F.col(c).alias(f"to_{c}") for c in at)).distinct()
    rows = index.vectors.join(routes, [F.col(c) == F.col(f"to_{c}") for c in at[:3]])

    def best(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "doc_id", "score"]
        if not len(queries) or not len(vectors):
            return pd.DataFrame({n: [] for n in names})
        x, ids = np.stack(vectors["embedding"].to_numpy()).astype(np.float64), vectors["doc_id"].to_numpy()
        out = []
        for i in range(0, len(queries), 256):
            some = queries.iloc[i : i + 256]
            score = np.round(np.stack(some["embedding"].to_numpy()).astype(np.float64) @ x.T, 6)
            top = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), top.shape[1]), "doc_id": ids[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()}))
        return pd.concat(out)

    asked = wanted.select("query_id", "embedding", *at)
    return asked.groupBy(*at).cogroup(rows.groupBy(*(f"to_{c}" for c in at))).applyInPandas(best, "query_id long, doc_id long, score double")


def knn(index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` vectors of largest dot product for each of ``queries(query_id, embedding)``, exactly, and what was read.

    ``(query_id, doc_id, score, rank)`` as a stored table; and one row ``(vectors, read)``: pairs of a query and a vector that there are,
    and that were scored. First the most promising cells that hold ``k`` vectors give a score that the best reach; then every other cell whose bound
    reaches it is read. Queries are routed to cells by joins; a task holds a cell's vectors and a block of queries.
    """
    cells = stored(bounded(index, queries), "vector-routes")
    promising = Window.partitionBy("query_id").orderBy(F.desc("bound"), "part", "ring", "slot")
    # As many cells as vectors are asked for hold that many vectors, and mostly a few do.
    order = cells.withColumn("nth", F.row_number().over(promising)).where(F.col("nth") <= k)
    order = order.withColumn("before", F.coalesce(F.sum("n").over(promising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = stored(order.where(F.col("before") < k).drop("nth", "before"), "vector-first")
    rank = F.row_number().over(best_first())
    found = stored(scored(index, first, k).withColumn("rank", rank).where(F.col("rank") <= k), "vector-found")
    theta = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    at = ["query_id", "part", "ring", "slot"]
    rest = cells.join(theta, "query_id", "left").where(F.col("theta").isNull() | (F.col("bound") >= F.col("theta") - SLACK)).join(first.select(*at), at, "left_anti")
    rest = stored(rest.drop("theta"), "vector-rest")
    both = found.drop("rank").unionByName(scored(index, rest, k))
    top = stored(both.withColumn("rank", rank).where(F.col("rank") <= k), "vector-top")
    read = first.select("n").unionByName(rest.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"))
    return top, stored(cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors")).join(read), "vector-reads")
