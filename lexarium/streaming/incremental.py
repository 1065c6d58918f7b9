"""Incremental loads: windows with an overlap, and a stream that upserts with a checkpoint as its watermark."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexarium.sources.writers import VersionedTable


def in_window(rows: DataFrame, stamp: str, lower: datetime, upper: datetime) -> DataFrame:
    """Rows in (lower, upper]."""
    return rows.where((F.col(stamp) > F.lit(lower)) & (F.col(stamp) <= F.lit(upper)))


def latest(rows: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The newest row of each key, of equally new ones that with the largest ``tie``."""
    best = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, batch: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    return latest(base.unionByName(batch), key, stamp, tie)


def current(table: VersionedTable, key: str, stamp: str, tie: str) -> DataFrame:
    """The newest row of each key of a table that a stream appends to."""
    return latest(table.read(), key, stamp, tie)


def compact(table: VersionedTable, key: str, stamp: str, tie: str) -> str:
    """A version that holds the newest rows only; it raises if rows are appended meanwhile, and can be run again."""
    return table.promote(current(table, key, stamp, tie), since=table.versions()[-1])


def stream_upsert(
    stream: DataFrame, table: VersionedTable, key: str, stamp: str, tie: str, checkpoint: str, overlap: str = "48 hours", every: str | None = None
) -> StreamingQuery:
    """Appends a batch's newest rows to the table, which ``current`` reads: run what is there, or start ``every`` interval.

    Late rows within ``overlap`` are taken; repeats of (tie) within it are dropped. An empty batch only moves the checkpoint. The table notes the
    number of the stream's last batch with the rows, in one step: a batch that runs twice, because the driver died between the table and the
    checkpoint, is in the table once.
    """
    name = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.append(latest(batch, key, stamp, tie), batch=(name, number))

    fresh = stream.withWatermark(stamp, overlap).dropDuplicatesWithinWatermark([tie])
    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
