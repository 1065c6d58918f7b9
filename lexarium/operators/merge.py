"""Keyed merge with an explicit delta, group-wise replacement, purge and update by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions import urls

#: Columns that track ingestion and don't count as a change.
TRACKING = ("ingest_label", "ingest_job_id", "ingested_at")


def signature(df: DataFrame, key: str = "merge_key") -> Column:
    """Hash of all columns but the tracking ones and the key; a null and a missing value are the same."""
    own = sorted(c for c in df.columns if c not in TRACKING and c != key and not c.startswith("_"))
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def without_groups(base: DataFrame, new: DataFrame, group: str = "ticket_group") -> DataFrame:
    """``base`` without the rows of groups that ``new`` holds; rows without a group stay."""
    return base.join(new.where(F.col(group).isNotNull()).select(group).distinct(), group, "left_anti")


def merge(base: DataFrame, new: DataFrame, key: str = "merge_key", group: str | None = None, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, classified new rows). Last one wins a key; ``position`` orders rows within ``new`` (default: key).

    With ``group``, whole groups of ``new`` replace those of ``base`` first, so an unchanged row of a replaced
    group counts as new. Each row of ``new`` is compared with the row of its key before it: it is ``new``,
    ``updated`` or ``unchanged`` (column ``change``); several rows of one key may thus be in the delta.
    """
    kept = without_groups(base, new, group) if group else base
    at = F.col(position) if position else F.lit(0)
    base_rows = kept.withColumn("_sig", signature(kept, key)).withColumn("_at", F.lit(0)).withColumn("_new", F.lit(0))
    new_rows = new.withColumn("_sig", signature(new, key)).withColumn("_at", at + 1).withColumn("_new", F.lit(1))
    every = base_rows.unionByName(new_rows, allowMissingColumns=True)
    in_order = Window.partitionBy(key).orderBy("_new", "_at")
    before = F.lag("_sig").over(in_order)
    change = F.when(before.isNull(), "new").when(before != F.col("_sig"), "updated").otherwise("unchanged")
    told = every.withColumn("change", change)
    merged = told.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("_at")))).where("_n = 1")
    helpers = ["_sig", "_at", "_new", "_n"]
    return merged.drop("change", *helpers), told.where("_new = 1").drop(*helpers)


def delta(classified: DataFrame) -> DataFrame:
    return classified.where("change <> 'unchanged'")


def summary(base: DataFrame, new: DataFrame, merged: DataFrame, classified: DataFrame, group: str | None = None) -> DataFrame:
    """One row of counters."""
    kept = without_groups(base, new, group) if group else base
    counts = classified.agg(
        F.count("*").alias("new_rows"),
        F.count_if(F.col("change") != "unchanged").alias("delta_rows"),
        F.count_if(F.col("change") == "new").alias("new_count"),
        F.count_if(F.col("change") == "updated").alias("updated_count"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged_count"),
    )
    groups = new.agg((F.countDistinct(group) if group else F.lit(0)).cast("bigint").alias("affected_ticket_groups"))
    sizes = (
        base.agg(F.count("*").alias("base_rows"))
        .crossJoin(kept.agg(F.count("*").alias("base_rows_effective")))
        .crossJoin(merged.agg(F.count("*").alias("out_rows")))
    )
    return sizes.crossJoin(counts).crossJoin(groups).withColumn("ticket_rows_removed", F.col("base_rows") - F.col("base_rows_effective"))


def purge(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row of counts before, removed, after)."""
    hit = F.coalesce(where, F.lit(False))
    counts = df.agg(F.count("*").alias("before"), F.count_if(hit).alias("removed"), F.count_if(~hit).alias("after"))
    return df.where(~hit), counts


def any_host(columns: list[Column], host: str) -> Column:
    """Whether one of the columns is a url of the host or names it anywhere."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce((urls.host(c) == host.lower()) | F.contains(F.lower(c), F.lit(host.lower())), F.lit(False))
    return out


def migrate(df: DataFrame, column: str, value: str, where: Column) -> DataFrame:
    """``column`` set to ``value`` where the predicate holds; ``changed`` says for which rows that is a change."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumn("changed", hit & (F.coalesce(F.col(column), F.lit("")) != value)).withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def keep_longest(df: DataFrame, keys: list[str], length: Column, position: str) -> DataFrame:
    """Of each key the longest row, of equally long ones the first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(length), position)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dataset_order() -> list[Column]:
    return [F.coalesce(F.col("ticket_id").try_cast("bigint"), F.lit(10**15)), F.coalesce("conversation_id", F.lit("")), F.coalesce("chunk_id", F.lit(""))]
