"""Sinks: JSON lines, split writes, versioned tables with a checked promotion, retention, run log."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_department(df: DataFrame, path: str) -> None:
    """One folder a department. Rows of a department are spread over tasks first, so a large one is many files."""
    spread = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(32)))
    spread.repartition("department", "_part").drop("_part").write.mode("overwrite").partitionBy("department").json(path)


class Versions:
    """Numbered states of something, each a small JSON file: the newest whole one counts.

    A state is made from the one before and claims the next number by creating its file, which only one writer can; the other
    looks at what has come meanwhile and claims the number after. A file that is not whole yet is no state for readers; a writer
    that stays in its way for longer than ``PATIENCE`` seconds has died, and its file goes.
    """

    PATIENCE = 30.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, first: str) -> list[str]:
        """Files and folders whose name begins with ``first``, in order."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n for n in names if n.startswith(first))

    def held(self, version: str) -> dict | None:
        """A state by its name; None if it is not whole."""
        stream = self._fs.open(self._path(f"{self.root}/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def newest(self) -> tuple[str, dict]:
        """Name and content of the newest state; ``("", {})`` if there is none."""
        for name in reversed(self.names("v")):
            if (found := self.held(name)) is not None:
                return name, found
        return "", {}

    def commit(self, change: Callable[[dict], dict]) -> str:
        """The state that ``change`` makes of the newest one; ``change`` is called again if another writer was faster."""
        waiting, since = "", 0.0
        while True:
            before, state = self.newest()
            names = self.names("v")
            if names and names[-1] > before:
                # A writer has claimed a number and not ended.
                if waiting != names[-1]:
                    waiting, since = names[-1], time.monotonic()
                elif time.monotonic() - since > self.PATIENCE:
                    self._fs.delete(self._path(f"{self.root}/{waiting}"), False)
                time.sleep(0.05)
                continue
            name = f"v{int(before[1:] or 0) + 1:012d}"
            content = bytearray(json.dumps(change(state)).encode())
            try:
                out = self._fs.create(self._path(f"{self.root}/{name}"), False)
            except Exception:
                if not self._fs.exists(self._path(f"{self.root}/{name}")):
                    raise
                continue
            out.write(content)
            out.close()
            return name

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Repeated(Exception):
    """A batch that is in the table already."""


class VersionedTable:
    """Versions of a table: each names the data folders that make it up, and is written after a check.

    Data is written once: an append adds a folder and names the others again, so it costs what the delta costs. Writers may run at
    the same time: each append is in the versions after it.
    """

    #: Folders that no version names are deleted when they are so old: a younger one may be about to be named.
    ORPHAN_SECONDS = 24 * 3600

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Versions(spark, root)

    def versions(self) -> list[str]:
        """Promoted versions, oldest first."""
        return self.log.names("v")

    def read(self) -> DataFrame:
        name, state = self.log.newest()
        if not name:
            raise FileNotFoundError(f"no promoted version in {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in state["parts"]])

    def _write(self, df: DataFrame, rows: int | None, extend: bool, batch: tuple[str, int] | None = None, since: str | None = None) -> str:
        """A part, read back and counted, and then the version that names it.

        ``batch`` (a stream's name and its batch's number) is noted in the version: a batch that is there already changes nothing. With ``since`` the
        version must still be the newest one.
        """
        have, state = self.log.newest()
        if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return have
        part = f"d{time.time_ns()}"
        df.write.parquet(f"{self.root}/{part}")
        written = self.spark.read.parquet(f"{self.root}/{part}").count()
        if rows is not None and written != rows:
            self.log.delete(part)
            raise ValueError(f"{written} rows written, {rows} expected")

        def grown(state: dict) -> dict:
            if since is not None and self.log.newest()[0] != since:
                raise RuntimeError("another version came first: run this again")
            batches = state.get("batches", {})
            if batch and batches.get(batch[0], -1) >= batch[1]:
                raise Repeated
            before = state if extend else {}
            batches = batches | {batch[0]: batch[1]} if batch else batches
            return {"parts": [*before.get("parts", []), part], "rows": before.get("rows", 0) + written, "batches": batches}

        try:
            return self.log.commit(grown)
        except (Repeated, RuntimeError) as e:
            # Nobody has seen the part.
            self.log.delete(part)
            if isinstance(e, Repeated):
                return self.log.newest()[0]
            raise

    def promote(self, df: DataFrame, rows: int | None = None, since: str | None = None) -> str:
        """A version of its own, of ``rows`` rows where that is known; if the check fails the one before stays.

        With ``since``, the version that ``df`` was made from, it raises where another version has come meanwhile.
        """
        return self._write(df, rows, False, since=since)

    def append(self, delta: DataFrame, rows: int | None = None, batch: tuple[str, int] | None = None) -> str:
        """The version that is current when the delta is written, and ``delta``, of ``rows`` rows where that is known.

        A ``batch`` of a stream, told by the stream's name and a number that grows, is taken once however often it is given.
        """
        return self._write(delta, rows, True, batch)

    def append_or_rebuild(self, delta: DataFrame, everything: DataFrame) -> str:
        try:
            return self.append(delta)
        except Exception as first:
            try:
                return self.promote(everything)
            except Exception as second:
                raise RuntimeError(f"append failed ({first}), rebuild failed ({second})") from second

    def roll_back(self) -> str:
        """Drops the newest version; the one before is read from now on."""
        have = self.versions()
        if len(have) < 2:
            raise ValueError("no version to go back to")
        self.log.delete(have[-1])
        return have[-2]

    def retain(self, keep: int, apply: bool = True) -> list[str]:
        """Names of versions beyond the newest ``keep``, deleted with the data that only they name if ``apply``.

        Folders that no version names go too once they are a day old; younger ones may belong to a writer under way.
        """
        have = self.versions()
        old = have[: -keep or None] if keep > 0 else []
        if apply and old:
            parts = {v: set((self.log.held(v) or {}).get("parts", [])) for v in have}
            stay, go = (set().union(*(parts[v] for v in some)) for some in (have[len(old) :], old))
            aged = {p for p in self.log.names("d") if p[1:].isdigit() and time.time_ns() - int(p[1:]) > self.ORPHAN_SECONDS * 10**9}
            for name in [*old, *sorted((go | aged) - stay)]:
                self.log.delete(name)
        return old


class VectorTable:
    """Vectors by document key: a versioned table ``(doc_key, embedding)`` without nulls, one vector a key."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = VersionedTable(spark, root)

    @staticmethod
    def _rows(vectors: DataFrame) -> DataFrame:
        return vectors.where("doc_key is not null and embedding is not null").select("doc_key", "embedding").dropDuplicates(["doc_key"])

    def rebuild(self, vectors: DataFrame) -> str:
        return self.table.promote(self._rows(vectors))

    def append(self, vectors: DataFrame) -> str:
        """Vectors of keys that the table lacks."""
        rows = self._rows(vectors)
        return self.table.append(rows.join(self.table.read().select("doc_key"), "doc_key", "left_anti") if self.table.versions() else rows)

    def read(self) -> DataFrame:
        return self.table.read()
