"""BM25 over an index in buckets by document, and over its blocks without scoring every posting; both are exact.

A block holds the postings of one token whose counts, document lengths and document shard are of one class. Its largest
count and shortest document bound what it adds to any score, whatever the mean length is, so bounds stay true when the corpus
changes. The shard splits the postings of a word that most documents hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.explode import exploded
from lexarium.functions.text import tokens
from lexarium.storage import bucketed, scratch, stored

# BM25's parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a shard, about; a block holds at most as many postings.
SHARD_DOCS = 1024
#: Documents of a bucket of shards, about: a task scores the documents of one bucket for all queries of a batch.
BUCKET_DOCS = 2048
#: Query terms that every task holds at once, about; more are done in batches.
BATCH_TERMS = 1 << 16
#: Keys that are broadcast to the rows of a large table; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: A query's first threshold comes from its heaviest tokens: so many postings for each document asked for.
LEAD = 16
#: Scores are rounded to six digits: what may still tie with the last place.
SLACK = 2e-6


def impact(tf: Column, dl: Column, mean_length: float) -> Column:
    """What a token's count in a document of ``dl`` tokens adds for each unit of its weight: grows with ``tf``, falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_length))


def length_class(dl: Column) -> Column:
    """Documents of like length: half powers of two."""
    return F.floor(2 * F.log2(dl))


def block_of(doc: Column, tf: Column, dl: Column, shards: int) -> Column:
    """The block of a posting within its token: classes of count and length, and the document's shard."""
    return (length_class(tf) * 128 + length_class(dl)) * (1 << 24) + shard_of(doc, shards)


def shard_of(doc: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(shards))


def best_first(score: str = "score") -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """Postings ``(doc_id, token, tf, dl)`` of ``(doc_id, text)``, with columns to ``keep`` behind."""
    terms = exploded(docs, tokens(F.col("text")), "token", "doc_id", *keep, size="dl")
    return terms.groupBy("doc_id", "token", "dl", *keep).agg(F.count("*").alias("tf")).select("doc_id", "token", "tf", "dl", *keep)


def directory(postings: DataFrame, shards: int, *keep: str) -> DataFrame:
    """``(token, block, top_tf, least_dl, n)`` of each block, with columns to ``keep`` that a block has one value of in front."""
    own = postings.withColumn("block", block_of(F.col("doc_id"), F.col("tf"), F.col("dl"), shards))
    return own.groupBy(*keep, "token", "block").agg(F.max("tf").alias("top_tf"), F.min("dl").alias("least_dl"), F.count("*").alias("n"))


@dataclass
class LexicalIndex:
    """Term counts with what BM25 needs; the corpus's size is three numbers. ``blocks`` are made when they are first asked for."""

    postings: DataFrame  # doc_id, token, tf, dl
    weights: DataFrame  # token, df, idf
    docs: DataFrame  # doc_id
    n: int
    total: int
    shards: int
    held_blocks: DataFrame | None = None  # token, block, top_tf, least_dl, n
    by_shard: DataFrame | None = None  # the postings with their shard, as a table in buckets by shard

    @property
    def mean_length(self) -> float:
        return self.total / self.n if self.total else 1.0

    @property
    def buckets(self) -> int:
        return buckets_of(self.docs, self.n)

    @property
    def blocks(self) -> DataFrame:
        if self.held_blocks is None:
            own = directory(self.postings if self.by_shard is None else self.by_shard, self.shards, *(() if self.by_shard is None else ("shard",)))
            self.held_blocks = stored(own, "posting-blocks") if self.by_shard is None else bucketed(own, "posting-blocks", self.buckets, "shard")
        return self.held_blocks

    @classmethod
    def build(cls, docs: DataFrame) -> LexicalIndex:
        """From ``(doc_id, text)``. Weights below zero become EPSILON times the mean weight.

        Texts are dealt by shard before they are split, so postings, which are many times as many rows, are counted and stay where they are made.
        """
        n = docs.count()
        shards, buckets = n // SHARD_DOCS + 1, buckets_of(docs, n)
        dealt = docs.select("doc_id", "text", shard_of(F.col("doc_id"), shards).alias("shard")).repartition(buckets, "shard")
        held = bucketed(counted(dealt, "shard"), "postings", buckets, "shard", "doc_id")
        postings = held.drop("shard")
        known = stored(postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "term-counts")
        total = known.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        return cls(postings, weighted(known.select("token", "df"), n), docs.select("doc_id"), n, total, shards, by_shard=held)

    def dealt(self, terms: DataFrame) -> DataFrame:
        """The postings of the tokens of ``terms`` at least, with their shard, dealt by it: what joins or groups by ``shard`` and more moves none."""
        if self.by_shard is not None:
            return self.by_shard
        own = self.postings.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi")
        return own.select("doc_id", "token", "tf", "dl", shard_of(F.col("doc_id"), self.shards).alias("shard")).repartition(self.buckets, "shard")


def buckets_of(df: DataFrame, n: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, n // BUCKET_DOCS + 1)


def weighted(known: DataFrame, n: int) -> DataFrame:
    """``(token, df, ...)`` with ``idf`` by a corpus of ``n`` documents."""
    raw = known.withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    return raw.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")))


def query_terms(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, token, df, w)``: a token's weight in a query, where repeated ones count again."""
    terms = exploded(queries, tokens(F.col("text")), "token", "query_id").groupBy("query_id", "token").agg(F.count("*").alias("times"))
    return terms.join(index.weights, "token").select("query_id", "token", "df", (F.col("times") * F.col("idf")).alias("w"))


def bm25(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Scores of all documents that share a token with the ``query_terms`` of some queries: every posting of every token.

    ``terms`` are held by every task. A document's postings lie together, so its scores are summed up where they are read: pairs of query and
    document, of which there are about as many as queries times documents, are never moved or written.
    """
    part = F.col("w") * impact(F.col("tf"), F.col("dl"), index.mean_length)
    own = index.dealt(terms).join(F.broadcast(terms.select("query_id", "token", "w")), "token")
    return own.groupBy("query_id", "shard", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).drop("shard")


@dataclass
class Pruned:
    """The parts of a pruned search; ``lead``, ``kept`` and ``looked_up`` are the postings that it reads."""

    lead: DataFrame  # all postings of the heaviest tokens
    kept: DataFrame  # postings of blocks that may hold one of the best
    looked_up: DataFrame  # light tokens of documents that may still be among the best
    scores: DataFrame  # query_id, doc_id, score


def pruned(index: LexicalIndex, terms: DataFrame, k: int) -> Pruned:
    """Scores that are exact for the ``k`` best documents of each query and too low at most for others.

    ``terms`` are ``query_terms`` without negative weights. A query's heaviest tokens give a score that its ``k`` best reach (theta). For
    documents of like length, a token adds at most what its best block of that length allows, and a document of d tokens holds at most d of
    the query's. The lightest tokens, whose bounds together stay below theta, can't bring a document among the best alone: documents are found by
    the other tokens, and of these only in blocks whose bound and the bounds of all other tokens reach theta (a document among the best
    has no posting in another block). What they add up to, with the bounds of the light tokens, leaves few documents, whose
    light tokens are looked up by document and token.
    """
    part = F.col("w") * impact(F.col("tf"), F.col("dl"), index.mean_length)
    held = index.dealt(terms) if index.by_shard is not None else bucketed(index.dealt(terms), "bm25-postings", index.buckets, "shard")
    own = held.withColumns({"block": block_of(F.col("doc_id"), F.col("tf"), F.col("dl"), index.shards), "len": length_class(F.col("dl"))})
    blocks = index.blocks.withColumns({"len": length_class(F.col("least_dl")), "bound": impact(F.col("top_tf"), F.col("least_dl"), index.mean_length)})
    document = ["query_id", "shard", "doc_id", "len"]

    def kth(scores: DataFrame) -> DataFrame:
        return scores.withColumn("_n", F.row_number().over(best_first())).where(F.col("_n") == k).select("query_id", F.col("score").alias("theta"))

    heaviest = Window.partitionBy("query_id").orderBy(F.desc("w"), "token").rowsBetween(Window.unboundedPreceding, -1)
    first = terms.withColumn("before", F.coalesce(F.sum("df").over(heaviest), F.lit(0))).where(F.col("before") < LEAD * k)
    lead = own.join(F.broadcast(first.select("query_id", "token", "w")), "token").select(*document, part.alias("part"))
    theta = stored(kth(lead.groupBy(*document).agg(F.sum("part").alias("score"))), "bm25-theta")

    of_length = Window.partitionBy("query_id", "len")
    heavier, lighter = of_length.orderBy(F.desc("most"), "token"), of_length.orderBy("most", F.desc("token"))
    bounds = terms.join(blocks.groupBy("token", "len").agg(F.max("bound").alias("top")), "token").withColumn("most", F.col("w") * F.col("top"))
    bounds = bounds.withColumns({"nth": F.row_number().over(heavier), "up_to": F.sum("most").over(lighter.rowsBetween(Window.unboundedPreceding, 0))})
    holds = F.col("nth") <= F.ceil(F.pow(F.lit(2.0), (F.col("len") + 1) / 2))
    bounds = bounds.withColumn("every", F.sum(F.when(holds, F.col("most"))).over(of_length)).join(theta, "query_id", "left")
    reach = F.coalesce(F.col("theta") - SLACK, F.lit(0.0))
    bounds = stored(bounds.withColumns({"reach": reach, "light": F.col("up_to") < reach}).drop("theta", "df", "top", "nth"), "bm25-bounds")
    # Postings meet their block where they are; queries come to them.
    block_bounds = blocks.select(F.pmod("block", F.lit(1 << 24)).alias("shard") if "shard" not in blocks.columns else "shard", "token", "block", "bound")
    rated = own.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi").join(block_bounds.hint("shuffle_hash"), ["shard", "token", "block"])
    heavy = bounds.where("not light").select("query_id", "token", "len", "w", (F.col("reach") - F.col("every") + F.col("most")).alias("least"))
    kept = rated.join(F.broadcast(heavy), ["token", "len"]).where(F.col("w") * F.col("bound") >= F.col("least")).select(*document, part.alias("part"))
    # Made twice and never written: it has a row for most pairs of query and document.
    partial = kept.groupBy(*document).agg(F.sum("part").alias("score"))
    # The partial scores' own last place is a threshold too, and mostly a higher one.
    theta = stored(theta.unionByName(kth(partial)).groupBy("query_id").agg(F.max("theta").alias("theta")), "bm25-theta")
    rests = bounds.where("light").groupBy("query_id", "len").agg(F.max("up_to").alias("rest"))
    alive = partial.join(F.broadcast(theta), "query_id", "left").join(F.broadcast(rests), ["query_id", "len"], "left")
    alive = alive.where(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce(F.col("theta") - SLACK, F.lit(0.0)))
    alive = bucketed(alive.select(*document, "score"), "bm25-alive", index.buckets, "shard")
    pairs = alive.join(F.broadcast(bounds.where("light").select("query_id", "len", "token", "w")), ["query_id", "len"]).drop("score", "len")
    looked_up = own.join(pairs.hint("shuffle_hash"), ["shard", "doc_id", "token"]).select(*document, part.alias("part"))
    scores = alive.withColumnRenamed("score", "part").unionByName(looked_up).groupBy("query_id", "shard", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).drop("shard")
    return Pruned(lead, kept, looked_up, scores)


def reads(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(postings, lead, kept, looked_up)`` in one row: the postings of the queries' tokens, and those that a pruned search of ``k`` reads."""
    terms = stored(query_terms(index, queries), "query-terms")
    p = pruned(index, terms, k)
    out = terms.agg(F.sum("df").alias("postings"))
    for name in ("lead", "kept", "looked_up"):
        out = out.join(getattr(p, name).agg(F.count("*").alias(name)))
    return out


def bm25_top(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each query; where fewer match, documents without a match follow by id with 0.

    All postings of the queries' tokens are read, once for each batch of queries; a task keeps its ``k`` best a query. The result is a
    stored table; what led to it is deleted.
    """
    with scratch(queries.sparkSession):
        terms = stored(query_terms(index, queries), "query-terms")
        batches, top = max(1, -(-terms.count() // BATCH_TERMS)), None
        place = F.pmod(F.xxhash64("query_id"), F.lit(batches))
        for i in range(batches):
            scored = bm25(index, terms.where(place == i) if batches > 1 else terms)
            best = stored(scored.withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= k), "bm25-top")
            top = best if top is None else top.unionByName(best)
        found = queries.select("query_id").distinct().join(top.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
        short = found.where(F.coalesce("n", F.lit(0)) < k).select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
        # A short query has fewer than k matches, all of them in top: 2k first ids are enough to fill it.
        first = index.docs.orderBy("doc_id").limit(2 * k)
        fill = short.crossJoin(first).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) + F.col("n")
        fill = fill.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
        return stored(top.unionByName(fill.select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank")), "bm25-best", keep=True)


def with_few(rows: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """``rows`` whose ``on`` is in ``wanted``, a stored table: up to ``BROADCAST_ROWS`` of them come to the rows, which stay where they are."""
    few = wanted.select(*on).distinct()
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, list(on), "left_semi")


def overlaps(index: LexicalIndex, candidates: DataFrame, query_texts: DataFrame) -> DataFrame:
    """``(query_id, doc_id, rerank_score)``: the largest share of a text's distinct tokens that a candidate holds, over its query's texts.

    Read from the postings by document and token; candidates' texts are not split again.
    """
    forms = query_texts.groupBy("query_id").agg(F.collect_set(F.array_distinct(tokens(F.col("text")))).alias("forms"))
    forms = forms.select("query_id", F.posexplode("forms").alias("form", "qt")).select("query_id", "form", F.size("qt").alias("size"), F.explode("qt").alias("token"))
    pairs = candidates.select("query_id", "doc_id").join(forms, "query_id")
    # Postings of other documents go before anything is moved.
    own = with_few(index.postings.select("doc_id", "token"), candidates.select("doc_id"), "doc_id")
    held = own.join(pairs, ["doc_id", "token"]).groupBy("query_id", "doc_id", "form", "size").agg(F.count("*").alias("held"))
    best = held.groupBy("query_id", "doc_id").agg(F.max(F.round(F.col("held") / F.col("size"), 6)).alias("rerank_score"))
    # Candidates that a vector has and a text hasn't are no results.
    known = candidates.select("query_id", "doc_id").join(query_texts.select("query_id").distinct(), "query_id", "left_semi").join(index.docs, "doc_id", "left_semi")
    return known.join(best, ["query_id", "doc_id"], "left").fillna(0.0, ["rerank_score"])
