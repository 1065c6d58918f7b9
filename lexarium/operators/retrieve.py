"""Ranked retrieval: exact vector search, reciprocal-rank fusion, rescues, reranking and boosts.

Every function takes and returns DataFrames over (query_id, doc_id), so one plan answers one query or a
batch. Ranks come from scores rounded to six digits with the id as last key, so that order never
depends on the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.text import fold, tokens
from lexarium.operators.lexical import LexicalIndex, best_first, bm25, bm25_top, overlaps, with_few
from lexarium.storage import scratch, stored

__all__ = ["LexicalIndex", "best_first", "bm25", "bm25_top", "overlaps", "with_few"]

# Fusion constant, pools and boosts.
RRF_K = 60
SEMANTIC_K, LEXICAL_K, RESCUE_K, RERANK_N, FINAL_K = 64, 40, 24, 60, 8
SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 0.8, 0.2
DEPARTMENT_BOOST, EXACT_BONUS = 5.0, 2.5
LOW_INFO_CHARS, LOW_INFO_TOKENS, LOW_INFO_PENALTY = 80, 6, 6.0
TITLE_BOOST, INTRO_BOOST, LENGTH_BOOST, LENGTH_FROM = 1.5, 1.0, 0.5, 160
EXACT_MATCHES = 3
#: Places from which rescued exact matches are numbered: behind all candidates.
EXACT_SEQ = 1_000_000_000
#: Query vectors that a task holds at once; more are done in blocks.
QUERY_BLOCK = 4096


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors of largest dot product for each query, exactly: ``(query_id, doc_id, score, rank)``.

    ``vectors(doc_id, embedding)``, ``queries(query_id, embedding)``; unit vectors, so the order is that of distance. Driver and
    tasks hold one block of about ``QUERY_BLOCK`` queries; several blocks are answered and written one by one. A task keeps its
    best ``k`` a query and batch.
    """
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    place, out = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), None
    for i in range(blocks):
        held = [(r.query_id, r.embedding) for r in asked.where(place == i).orderBy("query_id").collect()]
        part = _knn_block(vectors, held, k).withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= k)
        part = stored(part, "knn-top") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _knn_block(vectors: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([e for _, e in queries], np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column("doc_id").to_numpy()
            if not len(docs) or not len(ids):
                continue
            rows = b.column("embedding").flatten().to_numpy().reshape(len(docs), -1).astype(np.float64)
            score = np.round(matrix @ rows.T, 6)
            best = np.lexsort((np.broadcast_to(docs, score.shape), -score), axis=1)[:, :k]
            q = np.repeat(ids, best.shape[1])
            yield pa.record_batch(
                {"query_id": q, "doc_id": docs[best].ravel(), "score": np.take_along_axis(score, best, axis=1).ravel()}
            )

    rows = vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "embedding")
    return rows.mapInArrow(run, "query_id long, doc_id long, score double")


def fuse(runs: list[tuple[DataFrame, float]], rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of ``(query_id, doc_id, rank)`` lists; weights of 0 or less are left out.

    ``(query_id, doc_id, fused_score, fused_rank)``; ties go to the document that an earlier list names first.
    """
    parts = [r.select("query_id", "doc_id", "rank", F.lit(i).alias("run"), F.lit(float(w)).alias("weight")) for i, (r, w) in enumerate(runs)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return fuse_runs(every, rrf_k)


def fuse_runs(every: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """As ``fuse``, of all lists in one: ``(query_id, doc_id, rank, run, weight)``, lists in the order of ``run``."""
    part = F.col("weight") / (rrf_k + F.col("rank"))
    scored = every.where("weight > 0").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 8).alias("fused_score"), F.min(F.struct("run", "rank")).alias("seq"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "seq", "doc_id")
    return scored.withColumn("fused_rank", F.row_number().over(order)).drop("seq")


def with_rescue(fused: DataFrame, semantic: DataFrame, top_n: int = RERANK_N, rescue: int = RESCUE_K) -> DataFrame:
    """The ``top_n`` fused documents and then the first ``rescue`` semantic ones that are not among them."""
    kept = fused.where(F.col("fused_rank") <= top_n).select("query_id", "doc_id", "fused_score", F.col("fused_rank").alias("seq"))
    unseen = semantic.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    unseen = unseen.withColumn("place", place).where(F.col("place") <= rescue)
    known = fused.select("query_id", "doc_id", "fused_score")
    more = unseen.join(known, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.coalesce("fused_score", F.lit(0.0)).alias("fused_score"), (F.lit(top_n) + F.col("place")).alias("seq")
    )
    return kept.unionByName(more)


def exact_rescue(candidates: DataFrame, lexical: DataFrame, holds: DataFrame, matches: int = EXACT_MATCHES) -> DataFrame:
    """Candidates, filled up to ``matches`` documents that hold the query's one token, in lexical order.

    ``holds(query_id, doc_id)`` names the documents that hold it. ``lexical`` is deliberately unfiltered.
    """
    have = candidates.join(holds, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("have"))
    unseen = lexical.join(holds, ["query_id", "doc_id"], "left_semi").join(candidates, ["query_id", "doc_id"], "left_anti")
    unseen = unseen.join(have, "query_id", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) + F.coalesce("have", F.lit(0))
    )
    more = unseen.where(F.col("place") <= matches).select(
        "query_id", "doc_id", F.lit(0.0).alias("fused_score"), (F.lit(EXACT_SEQ) + F.col("place")).cast("int").alias("seq")
    )
    return candidates.unionByName(more)


def overlap_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """Stand-in for a cross-encoder: share of the query's distinct tokens that the document holds."""
    q = F.array_distinct(query_tokens)
    return F.round(F.size(F.array_intersect(q, doc_tokens)) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(candidates: DataFrame, docs: DataFrame, query_texts: DataFrame, score=overlap_score) -> DataFrame:
    """Largest score of a candidate over the texts of its query ``(query_id, text)``: adds ``rerank_score``.

    ``score(query_tokens, doc_tokens)`` is any Column function; replace it by a model's Arrow UDF. Only candidates' texts are
    split into tokens, each once.
    """
    texts = query_texts.select("query_id", tokens(F.col("text")).alias("qt"))
    held = with_few(docs.select("doc_id", "text"), candidates, "doc_id")
    held = stored(held.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("dt")), "candidate-tokens")
    pairs = candidates.join(texts, "query_id").join(held, "doc_id").withColumn("s", score(F.col("qt"), F.col("dt")))
    best = pairs.groupBy("query_id", "doc_id").agg(F.max("s").alias("rerank_score"))
    return candidates.join(best, ["query_id", "doc_id"])


def final_top(reranked: DataFrame, k: int = FINAL_K) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("fused_score"), "seq", "doc_id")
    return reranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = FINAL_K) -> DataFrame:
    """The whole plan: two ranked lists, fusion, rescue, rerank, cut: ``(query_id, rank, doc_id, fused_score, rerank_score)``.

    The result is a stored table; the index and the lists are deleted.
    """
    with scratch(docs.sparkSession):
        semantic = stored(knn(vectors, query_vectors, SEMANTIC_K), "semantic-top")
        index = LexicalIndex.build(docs)
        lexical = bm25_top(index, queries, LEXICAL_K)
        fused = stored(fuse([(semantic, SEMANTIC_WEIGHT), (lexical, LEXICAL_WEIGHT)]), "fused")
        chosen = stored(with_rescue(fused, semantic), "candidates")
        best = final_top(chosen.join(overlaps(index, chosen, queries), ["query_id", "doc_id"]), k)
        return stored(best.select("query_id", "rank", "doc_id", "fused_score", "rerank_score"), "hybrid-search", keep=True)


def low_information(text: Column, source_type: Column, chars: Column | None = None) -> Column:
    """A page or PDF chunk with hardly any text."""
    size = F.length(text) if chars is None else F.when(chars > 0, chars).otherwise(F.length(text))
    little = (text == "") | (size < LOW_INFO_CHARS) | (F.size(tokens(text)) < LOW_INFO_TOKENS)
    return F.lower(source_type).isin("html", "pdf") & F.coalesce(little, F.lit(True))


def short_query_boost(query_tokens: Column, title: Column, text: Column, source_type: Column, page: Column, chunk: Column) -> Column:
    """Boost of a page or PDF chunk for queries of one or two tokens."""
    named = F.forall(query_tokens, lambda t: F.contains(fold(title), t)) & (F.coalesce(title, F.lit("")) != "")
    good = (
        F.when(named, TITLE_BOOST).otherwise(0.0)
        + F.when(page.isin(1, 2) & (F.coalesce(chunk, F.lit(0)) == 0), INTRO_BOOST).otherwise(0.0)
        + F.when(F.length(text) >= LENGTH_FROM, LENGTH_BOOST).otherwise(0.0)
    )
    applies = F.lower(source_type).isin("html", "pdf") & F.size(query_tokens).between(1, 2)
    return F.when(~applies, 0.0).when(low_information(text, source_type), -LOW_INFO_PENALTY).otherwise(good)


def pools(k: int, top_n: int = RERANK_N, dated: bool = False, short: bool = False, department: bool = False) -> dict[str, float]:
    """Pool sizes and weights for a request: filters and short queries widen the pools."""
    base = max(top_n, 4 * k)
    base = max(base, 20 * k, 100) if dated else base
    base = max(base, 150) if department else base
    out = {"semantic": max(base, 80) if short else base, "lexical": max(base, 120) if short else base}
    weights = (0.55, 0.45) if short else (SEMANTIC_WEIGHT, LEXICAL_WEIGHT)
    return out | {"semantic_weight": weights[0], "lexical_weight": weights[1]}


def overfetch(k: int, has_query: bool = True) -> int:
    return min(300, 4 * k) if has_query else k


def deletions(c: Column) -> Column:
    """A word and all words that lack one of its letters."""
    lacking = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), lacking))


def typo_candidates(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The vocabulary word one edit from each of ``words(word)``: ``(word, correction, frequency)``.

    Words of four letters or more with the same first letter; the most frequent, of equally frequent ones the first in
    code-point order. Two words one edit apart share a word that lacks a letter of either, so an equality join finds them.
    """
    v = vocabulary.where(F.length("token") >= 4).select(F.col("token").alias("correction"), "frequency", F.explode(deletions(F.col("token"))).alias("stem"))
    w = words.where((F.length("word") >= 4) & ~F.col("word").rlike("^[0-9]+$")).select("word", F.explode(deletions(F.col("word"))).alias("stem"))
    same_head = F.substring("word", 1, 1) == F.substring("correction", 1, 1)
    near = w.join(v, "stem").where(same_head & (F.levenshtein("word", "correction", 1) >= 0) & (F.col("word") != F.col("correction")))
    best = F.min(F.struct((-F.col("frequency")).alias("order"), "correction", "frequency"))
    return near.groupBy("word").agg(best.alias("b")).select("word", "b.correction", "b.frequency")


def date_search(rows: DataFrame, group: str, stamp: str, key: str, low=None, high=None, k: int | None = None) -> DataFrame:
    """Newest row of each group within inclusive dates, newest first; ``k`` None means all."""
    day = F.to_date(stamp)
    kept = rows.where(F.col(stamp).isNotNull())
    kept = kept.where(day >= F.lit(low).cast("date")) if low else kept
    kept = kept.where(day <= F.lit(high).cast("date")) if high else kept
    newest = Window.partitionBy(group).orderBy(F.desc(stamp), key)
    latest = kept.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").orderBy(F.desc(stamp), F.desc(F.col(group).cast("string")))
    return latest.limit(k) if k else latest


def one_per_group(ranked: DataFrame, group: str, k: int) -> DataFrame:
    """First row of each group of a query's list (rows without a group all stay), then the first ``k``."""
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row:"), F.col("rank").cast("string")))
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", own).orderBy("rank"))).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return first.withColumn("place", place).where(F.col("place") <= k)
