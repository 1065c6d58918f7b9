"""Small files beside tables: configuration, summaries, reports, the catalog's snapshot, locks and retries."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import catalog, merge
from lexarium.sources.writers import VersionedTable

TRUE, FALSE = ("1", "true", "yes", "on", "y", "t"), ("0", "false", "no", "off", "n", "f", "")


def truth(value, default: bool = False) -> bool:
    """A setting that may be written in several ways."""
    word = str(value).strip().lower()
    return default if value is None or word not in (*TRUE, *FALSE) else word in TRUE


# What a run's label may hold, its longest form, deepest crawl and widest overlap in hours.
LABEL, LABEL_MOST, DEPTH_MOST, OVERLAP_MOST = r"[A-Za-z0-9_.\- ]+", 120, 20, 168


def ingest_request(label: str | None = None, depth: int | None = None, overlap_hours: int | None = None, confirm: bool | None = None) -> str | None:
    """Checked arguments of an ingestion or (with ``confirm``) a purge; returns the label, blank as none. A ``ValueError`` says what is wrong."""
    if label is not None and not (0 < len(label) <= LABEL_MOST and re.fullmatch(LABEL, label)):
        raise ValueError("a label has 1 to 120 letters, digits, blanks or _ . -")
    if depth is not None and not 1 <= depth <= DEPTH_MOST:
        raise ValueError("depth is 1 to 20")
    if overlap_hours is not None and not 0 <= overlap_hours <= OVERLAP_MOST:
        raise ValueError("overlap is 0 to 168 hours")
    if confirm is not None and confirm is not True:
        raise ValueError("a purge must be confirmed")
    return (label or "").strip() or None


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval, fusion and retention with their defaults."""

    dataset_path: str = "data/dataset_final.jsonl"
    index_path: str = "data/index"
    use_index: bool = True
    semantic_k: int = 24
    lexical_k: int = 24
    semantic_rescue_k: int = 0
    semantic_weight: float = 0.6
    lexical_weight: float = 0.4
    rrf_k: int = 60
    rerank_top_n: int = 30
    final_k: int = 8
    backups_enabled: bool = True
    backups_kept: int = 1

    @classmethod
    def of(cls, given: dict) -> Settings:
        """From a parsed configuration (sections ``retrieval, fusion, index_backups``); unknown names are passed over."""
        sections = {k: v or {} for k, v in given.items() if v is None or isinstance(v, dict)}
        backups = sections.get("index_backups", {})
        named = {**sections.get("retrieval", {}), **sections.get("fusion", {})}
        renamed = {"faiss_dir": "index_path", "use_faiss_cache": "use_index"}
        named = {renamed.get(k, k): v for k, v in named.items()}
        named |= {"backups_enabled": backups.get("enabled"), "backups_kept": backups.get("keep_last")}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        made = {k: truth(v, True) if kinds[k] is bool else kinds[k](v) for k, v in named.items() if k in kinds and v is not None}
        if "backups_kept" in made:
            made["backups_kept"] = max(0, made["backups_kept"])
        return cls(**made)


class Files:
    """Whole small files in any store that Spark reaches; a write is seen as a whole or not at all."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def write(self, path: str, content: str) -> None:
        p, fs = self._at(path)
        aside, _ = self._at(f"{path}.{time.time_ns()}.tmp")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        # One rename that replaces: whoever reads, and whoever comes after a crash, finds the old content or the new.
        jvm = self.spark._jvm
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        whole = [fs.makeQualified(x) for x in (aside, p)]
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole[1].toUri(), self.spark._jsc.hadoopConfiguration()).rename(*whole, options)

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def write_json(self, path: str, value) -> None:
        self.write(path, json.dumps(value, ensure_ascii=False, indent=2, default=json_value) + "\n")

    def read_json(self, path: str):
        return json.loads(self.read(path))

    def stamp(self, path: str) -> dict | None:
        """Newest change and bytes of a file or folder, to tell whether it has changed; None if it does not exist."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        every, newest, size = fs.listFiles(p, True), 0, 0
        while every.hasNext():
            status = every.next()
            newest, size = max(newest, status.getModificationTime()), size + status.getLen()
        return {"modified": newest, "bytes": size}

    @contextmanager
    def lock(self, path: str, stale_after: float = 6 * 3600) -> Iterator[None]:
        """One writer at a time: the lock is a file that only one can create; a second writer gets an error.

        A lock that is older than ``stale_after`` seconds was left by a driver that died, and is taken over. It holds its owner's name.
        """
        p, fs = self._at(path)
        owner = uuid.uuid4().hex
        for last in (False, True):
            try:
                out = fs.create(p, False)
                break
            except Exception as e:
                age = time.time() - self.stamp(path)["modified"] / 1000 if fs.exists(p) else 0.0
                if last or age <= stale_after:
                    raise RuntimeError(f"another writer holds {path}") from e
                fs.delete(p, False)
        out.write(bytearray(owner.encode()))
        out.close()
        try:
            yield
        finally:
            # Who was taken for dead leaves the other's lock alone.
            if fs.exists(p) and self.read(path).strip() == owner:
                fs.delete(p, False)


def json_value(value):
    """Values that JSON has no form for: times, decimals, bytes."""
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value).isoformat(sep=" ")
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).decode("utf-8", "replace")
    if hasattr(value, "asDict"):
        return value.asDict(True)
    number = getattr(value, "as_integer_ratio", None)
    return (int(value) if value == int(value) else float(value)) if number else str(value)


def summary(files: Files, path: str, one_row: DataFrame) -> dict:
    """A one-row table as a JSON file."""
    rows = one_row.take(2)
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    files.write_json(path, rows[0].asDict(True))
    return rows[0].asDict(True)


def report(files: Files, path: str, title: str, one_row: DataFrame) -> str:
    """A one-row table as a Markdown list under a heading; shares as per cent."""
    row = one_row.first().asDict()
    show = lambda k, v: f"{v:.2%}" if k.endswith("_pct") and isinstance(v, float) else "none" if v is None else str(v)
    told = "\n".join([f"# {title}", "", *(f"- {k.replace('_', ' ')}: {show(k, v)}" for k, v in row.items()), ""])
    files.write(path, told)
    return told


def run_totals(summaries: DataFrame) -> DataFrame:
    """Sums of the summaries of a run's files, how many files there were and how many changed nothing: one row."""
    numbers = [f.name for f in summaries.schema if f.dataType.simpleString() in ("bigint", "int")]
    return summaries.agg(
        F.count("*").alias("files"), F.count_if(F.col("delta_rows") == 0).alias("no_op_files"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers]
    )


class Watermark:
    """The time up to which rows have been taken; set only after all that depends on it is done."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path

    def get(self) -> datetime | None:
        return datetime.fromisoformat(self.files.read(self.path).strip()) if self.files.exists(self.path) else None

    def commit(self, value: datetime | None) -> None:
        if value is None:
            raise ValueError("an empty watermark is not written")
        self.files.write(self.path, value.isoformat())

    def run(self, upper: datetime, *steps: Callable[[], object]) -> None:
        """The steps in order; if one fails the watermark stays."""
        for step in steps:
            step()
        self.commit(upper)


def retried(job: Callable[[], object], retries: int = 1, wait: float = 300, sleep: Callable[[float], None] = time.sleep):
    """The job's result; a failed one is tried again ``retries`` times."""
    for left in range(retries, -1, -1):
        try:
            return job()
        except Exception:
            if not left:
                raise
            sleep(wait)


class CatalogSnapshot:
    """The catalog's entries as a table with the stamp of the dataset that they were made of."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.table, self.side = Files(spark), VersionedTable(spark, f"{root}/entries"), f"{root}/snapshot.json"

    def stale(self, dataset: str) -> bool:
        """Missing, unreadable or made of another dataset; a dataset that is gone leaves it as it is."""
        if not self.files.exists(self.side):
            return True
        now = self.files.stamp(dataset)
        if now is None:
            return False
        try:
            return self.files.read_json(self.side).get("dataset") != now or not self.table.versions()
        except ValueError:
            return True

    def rebuild(self, dataset: str, rows: DataFrame) -> DataFrame:
        """Entries of ``rows`` (as ``catalog.entries`` takes them), written and stamped."""
        stamp = self.files.stamp(dataset)
        self.table.promote(catalog.entries(rows))
        told = {"dataset": stamp, "generated_at": datetime.now(timezone.utc).isoformat(), "total_entries": self.table.read().count()}
        self.files.write_json(self.side, told)
        return self.table.read()

    def load_or_rebuild(self, dataset: str, rows: Callable[[], DataFrame]) -> DataFrame:
        return self.rebuild(dataset, rows()) if self.stale(dataset) else self.table.read()


def purged(table: VersionedTable, where: Column, dry_run: bool = True) -> dict:
    """Counts before, removed and after; unless it is a dry run, a version without the rows is promoted."""
    kept, counts = merge.purge(table.read(), where)
    told = counts.first().asDict() | {"dry_run": dry_run}
    if not dry_run and told["removed"]:
        table.promote(kept, told["after"])
    return told


class RunLog:
    """Runs of jobs as an append-only table: name, state, start, end and a JSON of what they told."""

    SCHEMA = "job string, state string, started timestamp, ended timestamp, told string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, VersionedTable(spark, root)

    def run(self, job: str, step: Callable[[], object]):
        """The step's result; its end, or its error, is logged."""
        started = datetime.now(timezone.utc).replace(tzinfo=None)

        def log(state: str, told) -> None:
            row = (job, state, started, datetime.now(timezone.utc).replace(tzinfo=None), json.dumps(told, default=json_value))
            self.table.append(self.spark.createDataFrame([row], self.SCHEMA), 1)

        try:
            out = step()
        except Exception as e:
            log("failed", {"error": str(e)[:500]})
            raise
        log("done", out)
        return out

    def read(self) -> DataFrame:
        return self.table.read()
