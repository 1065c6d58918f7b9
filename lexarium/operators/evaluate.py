"""Retrieval quality: precision, recall, MRR, nDCG, hit rates and agreement within groups of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.ids import blank_to_null

#: An evaluation row: expected ids, one or several, and graded judgments; numbers may come as text.
EXPECTED = (
    "query_id bigint, expected_ticket_id string, expected_ticket_ids array<string>, expected_conversation_id string, "
    "expected_conversation_ids array<string>, relevance_judgments array<struct<ticket_id:string,conversation_id:string,relevance:string>>"
)


def as_list(one: Column, many: Column) -> Column:
    """A value and a list of values as one list without nulls and blanks."""
    every = F.concat(F.array(one.cast("string")), F.coalesce(many.cast("array<string>"), F.array().cast("array<string>")))
    return F.array_compact(F.transform(every, blank_to_null))


def as_int_list(one: Column, many: Column) -> Column:
    """As ``as_list``, whole numbers only; others are left out."""
    return F.array_compact(F.transform(as_list(one, many), lambda x: F.regexp_extract(x, r"^[+-]?\d+$", 0).try_cast("bigint")))


def expected_relevance(rows: DataFrame) -> DataFrame:
    """``(query_id, identity, grade)`` of rows as ``EXPECTED``: an expected id counts 1, a judgment its grade, the largest wins.

    Grades below 0 count as 0, those that are no number as 1; identities are ``ticket:<id>`` and ``conversation:<id>``.
    """
    c = F.col
    named = lambda kind, x: F.concat(F.lit(f"{kind}:"), x.cast("string"))
    one = lambda kind: lambda x: F.struct(named(kind, x).alias("identity"), F.lit(1.0).alias("grade"))
    tickets = F.transform(as_int_list(c("expected_ticket_id"), c("expected_ticket_ids")), one("ticket"))
    talks = F.transform(as_list(c("expected_conversation_id"), c("expected_conversation_ids")), one("conversation"))
    grade = lambda j: F.greatest(F.coalesce(j["relevance"].try_cast("double"), F.lit(1.0)), F.lit(0.0))
    judged = F.coalesce(c("relevance_judgments"), F.array().cast("array<struct<ticket_id:string,conversation_id:string,relevance:string>>"))
    by_ticket = F.transform(judged, lambda j: F.struct(named("ticket", F.regexp_extract(j["ticket_id"], r"^\s*([+-]?\d+)\s*$", 1).try_cast("bigint")).alias("identity"), grade(j).alias("grade")))
    by_talk = F.transform(judged, lambda j: F.struct(named("conversation", blank_to_null(j["conversation_id"])).alias("identity"), grade(j).alias("grade")))
    told = rows.select("query_id", F.explode(F.concat(tickets, talks, by_ticket, by_talk)).alias("x")).select("query_id", "x.*")
    return told.where("identity is not null").groupBy("query_id", "identity").agg(F.max("grade").alias("grade"))


def result_identity(ticket: Column, conversation: Column, chunk: Column) -> Column:
    """Ticket, else conversation, else chunk of a result; empty if it has none."""
    named = lambda kind, x: F.concat(F.lit(f"{kind}:"), x.cast("string"))
    return F.coalesce(named("ticket", ticket.try_cast("bigint")), named("conversation", blank_to_null(conversation)), named("chunk", blank_to_null(chunk)), F.lit(""))


def graded_results(results: DataFrame, relevance: DataFrame) -> DataFrame:
    """``results(query_id, rank, ticket_id, conversation_id, ...)`` with the larger grade of their ticket and their conversation."""
    c = F.col
    by_ticket = relevance.select("query_id", c("identity").alias("_t"), c("grade").alias("_tg"))
    by_talk = relevance.select("query_id", c("identity").alias("_c"), c("grade").alias("_cg"))
    none = F.lit("")
    keyed = results.withColumn("_t", F.concat(F.lit("ticket:"), c("ticket_id").try_cast("bigint").cast("string")))
    keyed = keyed.withColumn("_c", F.concat(F.lit("conversation:"), F.coalesce(blank_to_null(c("conversation_id")), none)))
    told = keyed.join(by_ticket, ["query_id", "_t"], "left").join(by_talk, ["query_id", "_c"], "left")
    return told.withColumn("grade", F.greatest(F.coalesce("_tg", F.lit(0.0)), F.coalesce("_cg", F.lit(0.0)))).drop("_t", "_c", "_tg", "_cg")


def graded(results: DataFrame, relevance: DataFrame) -> DataFrame:
    """``(query_id, doc_id, rank)`` with the grade of each row; several grades of a document: the largest, not below 0."""
    best = relevance.groupBy("query_id", "doc_id").agg(F.greatest(F.max("grade"), F.lit(0)).alias("grade"))
    return results.join(best, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def query_metrics(results: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Metrics at ``k`` by query. nDCG compares with the retrieved grades in their best order; recall's base is all relevant documents."""
    rows = graded(results, relevance)
    total = relevance.where("grade > 0").groupBy("query_id").agg(F.countDistinct("doc_id").alias("relevant"))
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    top = rows.withColumn("ideal", ideal)
    by_query = top.groupBy("query_id").agg(
        F.sum(F.when((F.col("rank") <= k) & (F.col("grade") > 0), 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)).otherwise(0.0)).alias("best"),
    )
    return by_query.join(total, "query_id", "left").select(
        "query_id",
        F.round(F.col("hits") / k, 6).alias("precision"),
        F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg"),
        F.coalesce(F.col("first") <= 1, F.lit(False)).cast("bigint").alias("top1"),
        F.coalesce(F.col("first") <= 3, F.lit(False)).cast("bigint").alias("top3"),
    )


def overall(metrics: DataFrame) -> DataFrame:
    names = ("precision", "recall", "mrr", "ndcg", "top1", "top3")
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 5).alias(n) for n in names])


def group_agreement(results: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Mean Jaccard of the result sets of all pairs of queries in a group; two empty sets agree.

    ``groups(query_id, grp)`` is an evaluation set of bounded size, so the pairs of a group are few.
    """
    sets = groups.join(results.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias("docs")), "query_id", "left")
    sets = sets.withColumn("docs", F.coalesce("docs", F.array().cast("array<bigint>")))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.query_id") < F.col("b.query_id")))
    union = F.size(F.array_union("a.docs", "b.docs"))
    same = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a.docs", "b.docs")) / union)
    return pairs.groupBy(F.col("a.grp").alias("grp")).agg(F.count("*").alias("pairs"), F.round(F.avg(same), 6).alias("agreement"))
