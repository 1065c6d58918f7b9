"""Corpus profile and chunk quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.text import EMAIL, PHONE, QUOTE, SIGNATURE, URL
from lexarium.storage import stored


def floor_percentiles(of: dict[str, tuple[DataFrame, str]], shares: dict[str, float]) -> DataFrame:
    """One row with ``<name>_<share>``: the value at rank floor((n - 1) * share) of each named column, 0 for no rows.

    Equal values are counted first. The counts are dealt to ranges and written, so that a range stays what it is when a task runs again; the
    ranges' sums (one row a range) tell in which of them a wanted rank lies, and only those are sorted. Nothing meets in one task but a row
    a range, whatever the values are.
    """
    parts = [
        df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("bigint").alias("v")).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "v", "n")
        for name, (df, c) in of.items()
    ]
    counts = reduce(DataFrame.unionByName, parts)
    dealt = stored(counts.repartitionByRange("what", "v").withColumn("part", F.spark_partition_id()), "value-ranges")
    before = Window.partitionBy("what").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("what", "part").agg(F.sum("n").alias("own"))
    ranges = ranges.withColumns({"below": F.coalesce(F.sum("own").over(before), F.lit(0)), "total": F.sum("own").over(Window.partitionBy("what"))})
    wanted = [F.struct(F.lit(k).alias("share"), F.floor((F.col("total") - 1) * F.lit(p)).alias("rank")) for k, p in shares.items()]
    ranges = ranges.withColumn("w", F.explode(F.array(*wanted))).select("what", "part", "below", "own", "w.*")
    ranges = ranges.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("own")))
    # At most one range a share and column: the join keeps only the values of these.
    inside = dealt.join(F.broadcast(ranges.select("what", "part").distinct()), ["what", "part"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("what", "part").orderBy("v"))
    found = inside.withColumn("upto", upto).join(F.broadcast(ranges), ["what", "part"]).where(F.col("below") + F.col("upto") > F.col("rank"))
    found = found.groupBy("what", "share").agg(F.min("v").alias("v"))
    at = lambda name, k: F.coalesce(F.min(F.when((F.col("what") == name) & (F.col("share") == k), F.col("v"))), F.lit(0))
    return found.agg(*[at(name, k).alias(f"{name}_{k}") for name in of for k in shares])


def floor_percentile(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """As ``floor_percentiles``, of one column; columns are named as the shares are."""
    one = floor_percentiles({"v": (df, column)}, shares)
    return one.select(*(F.col(f"v_{k}").alias(k) for k in shares))


def one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def profile_messages(messages: DataFrame) -> DataFrame:
    """Counts and length percentiles of ``(conv_id, turn, role, text)``: one row."""
    size = messages.withColumn("chars", F.length("text"))
    convs = size.groupBy("conv_id").agg(F.count("*").alias("n"), (F.sum("chars") + F.count("*") - 1).alias("chars"))
    has = lambda p: F.count_if(F.regexp_like("text", F.lit(p)))
    totals = size.agg(
        F.count("*").alias("messages"),
        F.countDistinct("conv_id").alias("conversations"),
        has(SIGNATURE).alias("signature_messages"),
        has(QUOTE).alias("quote_messages"),
        has(URL).alias("url_messages"),
        F.sum(F.regexp_count("text", F.lit(EMAIL))).cast("bigint").alias("emails"),
        F.sum(F.regexp_count("text", F.lit(PHONE))).cast("bigint").alias("phones"),
    ).withColumn("messages_per_conversation", F.round(F.col("messages") / F.col("conversations"), 3))
    shares = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    return one_row(totals, floor_percentiles({"conv_messages": (convs, "n"), "message_chars": (size, "chars"), "conv_chars": (convs, "chars")}, shares))


def chunk_quality(chunks: DataFrame, group: str, low: int = 400, high: int = 600, tiny: int = 120, in_range: float = 0.9, tiny_share: float = 0.02) -> DataFrame:
    """Totals, length percentiles, shares in range and tiny, leaks and whether the thresholds hold: one row."""
    size = chunks.withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    groups = size.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("g")).agg(F.count("*").alias("n"))

    def share(c: Column) -> Column:
        return F.round(F.coalesce(F.count_if(c) / F.count("*"), F.lit(0.0)), 4)

    totals = size.agg(
        F.count("*").alias("total_chunks"),
        share(F.col("chars").between(low, high)).alias("in_range_pct"),
        share(F.col("chars") < tiny).alias("tiny_chunk_pct"),
        F.sum(F.regexp_count("text", F.lit(EMAIL))).cast("bigint").alias("email_leak"),
        F.sum(F.regexp_count("text", F.lit(PHONE))).cast("bigint").alias("phone_leak"),
        F.count_if(F.regexp_like("text", F.lit(SIGNATURE))).alias("signature_hits"),
    )
    totals = totals.withColumn("all_pass", (F.col("in_range_pct") >= in_range) & (F.col("tiny_chunk_pct") <= tiny_share))
    shares = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    return one_row(
        totals,
        groups.agg(F.count("*").alias("unique_groups")),
        floor_percentiles({"len": (size, "chars"), "per_group": (groups, "n")}, shares),
    )
