"""A stream that upserts: batches that run twice, late rows, empty batches, an interval."""

from __future__ import annotations

import shutil
import time
from datetime import datetime, timedelta

import pytest

from lexarium.sources.writers import VersionedTable
from lexarium.streaming import incremental

START = datetime(2024, 3, 1)
SCHEMA = "key long, at timestamp, id long, value string"


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        table, source, checkpoint = VersionedTable(spark, str(tmp_path / "table")), tmp_path / "in", str(tmp_path / "checkpoint")
        files = 0

        def add(self, *rows):
            """Rows (key, hours after the start, id, value) as one more file."""
            self.files += 1
            made = [(k, START + timedelta(hours=h), i, v) for k, h, i, v in rows]
            spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"made{self.files}"))
            for f in (tmp_path / f"made{self.files}").glob("*.parquet"):
                shutil.copy(f, self.source / f"{self.files:03d}.parquet")

        def start(self, every=None):
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.source))
            return incremental.stream_upsert(stream, self.table, "key", "at", "id", self.checkpoint, every=every)

        def run(self):
            query = self.start()
            query.awaitTermination(180)
            assert query.exception() is None

        def now(self):
            return {r.key: r.value for r in incremental.current(self.table, "key", "at", "id").collect()}

    (tmp_path / "in").mkdir()
    return Place()


def test_a_batch_that_runs_twice_is_there_once(spark, place, tmp_path):
    place.add((1, 0, 1, "a"), (2, 0, 2, "b"), (1, 1, 3, "c"))
    place.run()
    place.add((1, 2, 4, "d"))
    place.run()
    before = place.table.read().count()
    assert place.now() == {1: "d", 2: "b"} and before == 3
    # The driver died after the table was written and before the checkpoint was: its last commits are gone.
    commits = tmp_path / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in commits.iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    place.run()
    assert place.table.read().count() == before and place.now() == {1: "d", 2: "b"}
    incremental.compact(place.table, "key", "at", "id")
    assert place.table.read().count() == 2 and place.now() == {1: "d", 2: "b"}
    # The note of the batches outlives it.
    place.add((2, 5, 9, "e"))
    place.run()
    assert place.now() == {1: "d", 2: "e"}


def test_batches_are_noted_by_stream(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    first = table.append(spark.range(2), batch=("s", 0))
    assert table.append(spark.range(2), batch=("s", 0)) == first and table.read().count() == 2
    table.append(spark.range(3), batch=("other", 0))
    table.append(spark.range(4), batch=("s", 1))
    table.append(spark.range(5))
    assert table.read().count() == 14 and len([n for n in table.log.names("d")]) == 4
    since = table.versions()[-1]
    table.append(spark.range(1))
    with pytest.raises(RuntimeError, match="came first"):
        table.promote(spark.range(1), since=since)
    assert table.read().count() == 15 and len(table.log.names("d")) == 5


def test_late_rows_and_empty_batches(spark, place):
    place.add((1, 100, 1, "newest"))
    place.run()
    # 40 hours late: an older row of a known key, and the first of another key; 60 hours late: beyond the overlap.
    place.add((1, 60, 2, "older"), (2, 60, 3, "late"), (3, 40, 4, "too late"))
    place.run()
    assert place.now() == {1: "newest", 2: "late"}
    # A repeat within the overlap is dropped, and the batch is empty then.
    versions = len(place.table.versions())
    place.add((2, 60, 3, "late"))
    place.run()
    assert len(place.table.versions()) == versions and place.now() == {1: "newest", 2: "late"}
    place.run()
    assert len(place.table.versions()) == versions


def test_every_interval(spark, place):
    place.add((1, 0, 1, "a"))
    query = place.start(every="1 second")
    try:
        for added, want in ((None, {1: "a"}), ((1, 1, 2, "b"), {1: "b"})):
            if added:
                place.add(added)
            for _ in range(120):
                if place.table.versions() and place.now() == want:
                    break
                time.sleep(0.5)
            assert place.now() == want
    finally:
        query.stop()
