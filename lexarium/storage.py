"""Tables in the folder that driver and executors share: lineage is cut there, so a lost executor costs little."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Settings of a write: its shuffle files go as it ends, not when the driver next collects its garbage, and Python workers
#: get rows in small batches, so that neither side holds many long texts at once.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lexarium-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Writes under way in this process, and what the settings were before the first of them.
_writing = threading.Lock()
_writers, _before = 0, {}


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """Inside, the settings ``WRITING`` hold; those from before come back when the last of several writes at a time ends."""
    global _writers
    with _writing:
        if not _writers:
            _before.update({name: spark.conf.get(name, None) for name in WRITING})
        _writers += 1
        for name, value in WRITING.items():
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _writing:
            _writers -= 1
            for name, value in _before.items() if not _writers else ():
                if value is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, value)


#: The folder of each stored table.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Paths of the tables written inside each open ``scratch``, outermost first. Each thread has its own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``stored`` wrote inside, in the same thread: for results that were stored with ``keep``."""
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            deleted(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends here, shuffle files go.

    With ``keep`` the innermost open ``scratch`` leaves it to the next outer one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    holders = _scratch.get()
    holders = holders[: len(holders) - keep]
    if holders:
        holders[-1].append(path)
    with lean_writes(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, column: str, *sort: str) -> DataFrame:
    """As ``stored``, in ``buckets`` by ``column``, sorted by it and ``sort``: what joins or groups by ``column`` and more moves no row of it."""
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"lexarium_{uuid.uuid4().hex}"
    holders = _scratch.get()
    if holders:
        holders[-1].append(path)
    with lean_writes(spark):
        df.write.bucketBy(buckets, column).sortBy(column, *sort).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    # Only the catalog's entry goes: its files are not the catalog's, and the plan knows them.
    spark.sql(f"DROP TABLE {table}")
    _folders[out] = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``stored`` returned, once nothing reads it any more; other tables stay."""
    if df in _folders:
        deleted(df.sparkSession, _folders.pop(df))


def settled(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query with its result stored and all other tables that it wrote deleted."""

    @wraps(query)
    def run(spark: SparkSession, *given) -> DataFrame:
        with scratch(spark):
            return stored(query(spark, *given), query.__name__, keep=True)

    return run
