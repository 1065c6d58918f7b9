"""A lexical index on disk that is kept up to date by deltas: one small file says which folders make it up."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import lexical
from lexarium.sources.writers import Versions
from lexarium.storage import scratch, stored

#: Documents of one folder of postings, about, and the most folders: an update reads the folders of the documents that it replaces.
FOLDER_DOCS, FOLDERS = 100_000, 1024
#: Tasks that write a folder, at most.
FOLDER_TASKS = 16


class StoredIndex:
    """Segments of an index, each written once.

    A segment holds its documents ``docs(doc_id, dl)``, their ``postings`` (by folders of documents), the ``blocks`` of these, the documents
    of earlier segments that are ``gone``, and by token what it adds to the number of documents (``terms``, less what is gone). The number of
    documents and their length are sums too, so an update costs what its documents cost, whatever the corpus holds. A version names all
    segments: readers see an update as a whole or not at all.
    """

    PARTS = {
        "docs": "doc_id {id}, dl bigint",
        "postings": "doc_id {id}, token string, tf bigint, dl bigint, folder int",
        "blocks": "token string, block bigint, top_tf bigint, least_dl bigint, n bigint",
        "gone": "doc_id {id}, dl bigint",
        "terms": "token string, df bigint",
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Versions(spark, root)

    # ---- writing ---------------------------------------------------------------------------------------------------

    def rebuild(self, docs: DataFrame, keep: int = 1) -> str:
        """An index of ``docs(doc_id, text)`` in one segment; then versions beyond the newest ``keep + 1`` go."""
        n = docs.count()
        name = self._segment(docs, None, {"shards": n // lexical.SHARD_DOCS + 1, "folders": min(FOLDERS, n // FOLDER_DOCS + 1), "segments": [], "id": docs.schema["doc_id"].dataType.simpleString()})
        self.retain(keep + 1)
        return name

    def update(self, delta: DataFrame, removed: DataFrame | None = None) -> str:
        """Documents of ``delta(doc_id, text)`` are added or replace those of their id; those of ``removed(doc_id)`` go.

        An id in both is replaced. Repeated ids in ``delta`` raise; ids that nothing is known of are passed over in ``removed``.
        If another update comes first, it raises and nothing is changed: the counts of documents that go would not hold.
        """
        before, state = self.log.newest()
        if not before:
            raise FileNotFoundError(f"no index in {self.root}: rebuild it")
        return self._segment(delta, removed, state, before)

    def _segment(self, docs: DataFrame, removed: DataFrame | None, state: dict, before: str | None = None) -> str:
        name = f"s{time.time_ns()}"
        at = f"{self.root}/{name}"
        with scratch(self.spark):
            docs = docs.select("doc_id", "text")
            # Texts are dealt, so their postings are counted where they are made.
            counted = stored(lexical.counted(docs.repartition("doc_id")), "delta-postings")
            own = docs.select("doc_id").join(counted.select("doc_id", "dl").distinct(), "doc_id", "left").fillna(0, ["dl"])
            own.write.parquet(f"{at}/docs")
            own = self._part(state, name, "docs")
            added = own.agg(F.count("*"), F.countDistinct("doc_id"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if added[0] != added[1]:
                raise ValueError("a document id is null or repeated in the delta")
            folder = self._folder(F.col("doc_id"), state["folders"])
            counted.withColumn("folder", folder).repartition(*self._spread()).write.partitionBy("folder").parquet(f"{at}/postings")
            lexical.directory(counted, state["shards"]).write.parquet(f"{at}/blocks")
            df = counted.groupBy("token").agg(F.count("*").alias("df"))
            lost = (0, 0)
            if state["segments"]:
                asked = own.select("doc_id") if removed is None else own.select("doc_id").union(removed.select("doc_id")).distinct()
                self._live(state, "docs").join(asked, "doc_id", "left_semi").write.parquet(f"{at}/gone")
                gone = self._part(state, name, "gone")
                lost = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
                # At most as many numbers as there are folders: the scan leaves the others out.
                folders = [r[0] for r in gone.select(self._folder(F.col("doc_id"), state["folders"])).distinct().collect()]
                old = self._live(state, "postings", folders).join(gone.select("doc_id"), "doc_id", "left_semi")
                df = df.unionByName(old.groupBy("token").agg((-F.count("*")).alias("df"))).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
            else:
                own.limit(0).write.parquet(f"{at}/gone")
            df.write.parquet(f"{at}/terms")
        written = {p: self._part(state, name, p).count() for p in ("docs", "postings")}
        if written != {"docs": added[0], "postings": self._part(state, name, "blocks").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}:
            raise ValueError(f"{at} holds {written}: not what the delta has")

        def grown(now: dict) -> dict:
            if before is not None and now != state:
                raise RuntimeError("another update came first: run this one again")
            return state | {"segments": [*state["segments"], name], "n": state.get("n", 0) + added[0] - lost[0], "total": state.get("total", 0) + added[2] - lost[1]}

        return self.log.commit(grown)

    def compact(self) -> str:
        """One segment of what is live, from the stored postings: no text is read again."""
        before, state = self.log.newest()
        name = f"s{time.time_ns()}"
        at = f"{self.root}/{name}"
        shape = {"shards": state["n"] // lexical.SHARD_DOCS + 1, "folders": min(FOLDERS, state["n"] // FOLDER_DOCS + 1)}
        docs, postings = self._live(state, "docs"), self._live(state, "postings").drop("folder")
        docs.write.parquet(f"{at}/docs")
        docs.limit(0).write.parquet(f"{at}/gone")
        postings.withColumn("folder", self._folder(F.col("doc_id"), shape["folders"])).repartition(*self._spread()).write.partitionBy("folder").parquet(f"{at}/postings")
        postings = self._part(state, name, "postings").drop("folder")
        lexical.directory(postings, shape["shards"]).write.parquet(f"{at}/blocks")
        postings.groupBy("token").agg(F.count("*").alias("df")).write.parquet(f"{at}/terms")

        def grown(now: dict) -> dict:
            if now != state:
                raise RuntimeError("an update came first: run this again")
            return state | shape | {"segments": [name]}

        return self.log.commit(grown)

    def retain(self, keep: int) -> list[str]:
        """Drops versions beyond the newest ``keep`` and the segments that only they name."""
        have = self.log.names("v")
        old = have[: -keep or None] if keep > 0 else []
        named = {v: set((self.log.held(v) or {}).get("segments", [])) for v in have}
        stay = set().union(*(named[v] for v in have[len(old) :]))
        for name in [*old, *sorted(set().union(*(named[v] for v in old)) - stay)]:
            self.log.delete(name)
        return old

    # ---- reading ---------------------------------------------------------------------------------------------------

    @staticmethod
    def _folder(doc, folders: int):
        return F.pmod(F.xxhash64(doc), F.lit(folders)).cast("int")

    @staticmethod
    def _spread() -> list:
        """By what postings are dealt before they are written: several tasks a folder, as a large index has few folders."""
        return [F.col("folder"), F.pmod(F.hash("doc_id"), F.lit(FOLDER_TASKS))]

    def _part(self, state: dict, segment: str, part: str) -> DataFrame:
        return self.spark.read.schema(self.PARTS[part].format(id=state["id"])).parquet(f"{self.root}/{segment}/{part}")

    def _all(self, state: dict, part: str) -> DataFrame:
        """The rows of a part of all segments, with the number of their segment."""
        out = None
        for i, segment in enumerate(state["segments"]):
            rows = self._part(state, segment, part).withColumn("segment", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _live(self, state: dict, part: str, folders: list[int] | None = None) -> DataFrame:
        """Rows of documents that no later segment has replaced or removed."""
        rows = self._all(state, part)
        rows = rows if folders is None else rows.where(F.col("folder").isin(folders))
        if len(state["segments"]) > 1:
            gone = self._all(state, "gone").groupBy(F.col("doc_id").alias("gone")).agg(F.max("segment").alias("since"))
            # Few documents come to the rows: these are many, and stay where they are.
            gone = F.broadcast(gone) if gone.count() <= lexical.BROADCAST_ROWS else gone
            rows = rows.join(gone, (F.col("doc_id") == F.col("gone")) & (F.col("segment") < F.col("since")), "left_anti")
        return rows.drop("segment")

    def load(self) -> lexical.LexicalIndex:
        """The newest index; an error if there is none. Blocks may count postings that are gone: bounds stay true."""
        name, state = self.log.newest()
        if not name:
            raise FileNotFoundError(f"no index in {self.root}: rebuild it")
        n, total = state["n"], state["total"]
        blocks = self._all(state, "blocks").groupBy("token", "block").agg(F.max("top_tf").alias("top_tf"), F.min("least_dl").alias("least_dl"), F.sum("n").alias("n"))
        known = self._all(state, "terms").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        postings = self._live(state, "postings").select("doc_id", "token", "tf", "dl")
        return lexical.LexicalIndex(postings, lexical.weighted(known, n), self._live(state, "docs").select("doc_id"), n, total, state["shards"], blocks)
