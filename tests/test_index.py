"""Pruned searches, the index kept by deltas, and tables and files under several writers."""

from __future__ import annotations

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexarium.operators import lexical
from lexarium.sources.index_store import StoredIndex
from lexarium.sources.snapshots import Files
from lexarium.sources.writers import VersionedTable, Versions
from lexarium.storage import dropped, scratch, settled, shared_dir, stored


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    # Zipf: some words stand nearly everywhere, most hardly anywhere.
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(10_000, None)], "doc_id long, text string")
    asked = [" ".join(rng.choices(words, weights, k=n)) for n in (1, 3, 8, 20, 60)] + ["w0 w1 w2", "w399", "w0", "nothing here", "", "w7 w7 w7 w300"]
    return docs, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")


def best(scored, k):
    out: dict = {}
    for r in sorted(scored.where("score is not null").collect(), key=lambda r: (r.query_id, -r.score, r.doc_id)):
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return {q: rows[:k] for q, rows in out.items()}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_pruned_search_is_exact(spark, corpus, k, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 50)
    docs, asked = corpus
    index = lexical.LexicalIndex.build(docs)
    assert index.shards == 13 and index.n == 601
    terms = stored(lexical.query_terms(index, asked), "terms")
    want = best(lexical.bm25(index, terms), k)
    got = best(lexical.pruned(index, terms, k).scores, k)
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_pruned_search_reads_less(spark, corpus):
    docs, asked = corpus
    index = lexical.LexicalIndex.build(docs)
    read = lexical.reads(index, asked.where("query_id in (2, 3, 4)"), 3).first()
    assert read.kept < read.postings
    # Postings of a word that all documents hold are several blocks.
    assert index.blocks.where("token = 'w0'").count() > 3


def test_one_index_answers_several_searches(spark, corpus, monkeypatch):
    docs, asked = corpus
    asked = asked.where("query_id < 4")
    index = lexical.LexicalIndex.build(docs)
    want = sorted(map(tuple, lexical.bm25_top(index, asked, 5).collect()))
    monkeypatch.setattr(lexical, "PRUNE_FROM", 0, raising=False)
    for _ in range(2):
        assert sorted(map(tuple, lexical.bm25_top(index, asked, 5).collect())) == want


def test_scores_are_summed_up_where_postings_lie(spark, corpus):
    docs, asked = corpus
    index = lexical.LexicalIndex.build(docs)
    scores = lexical.bm25(index, stored(lexical.query_terms(index, asked), "terms"))
    # Queries are broadcast; neither postings nor pairs of query and document are shuffled.
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan


def test_few_keys_come_to_the_rows(spark, corpus, monkeypatch):
    docs, _ = corpus
    index = lexical.LexicalIndex.build(docs)
    few = stored(docs.where("doc_id < 5").select("doc_id"), "few")
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 4)
    want = sorted(map(tuple, lexical.with_few(index.postings, few, "doc_id").collect()))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lexical.with_few(index.postings, few, "doc_id")
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} <= set(range(5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps(spark, corpus):
    docs, asked = corpus
    index = lexical.LexicalIndex.build(docs)
    pairs = asked.select("query_id").crossJoin(docs.select("doc_id").limit(30))
    texts = asked.union(asked.select("query_id", F.substring_index("text", " ", 2).alias("text")))
    held = {r.doc_id: set((r.text or "").split()) for r in docs.collect()}
    forms: dict = {}
    for r in texts.collect():
        forms.setdefault(r.query_id, []).append(set(r.text.split()))
    for r in lexical.overlaps(index, pairs, texts).collect():
        want = max(len(f & held[r.doc_id]) / max(len(f), 1) for f in forms[r.query_id])
        assert r.rerank_score == pytest.approx(want, abs=1e-6)


def test_index_by_deltas_equals_a_rebuild(spark, corpus, tmp_path):
    docs, asked = corpus
    kept = StoredIndex(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        kept.load()
    with pytest.raises(FileNotFoundError):
        kept.update(docs)
    kept.rebuild(docs)
    changed = docs.where("doc_id % 7 = 0").withColumn("text", F.concat_ws(" ", F.lit("fresh w1"), "text"))
    new = spark.createDataFrame([(20_000, "fresh w5 w5"), (20_001, "")], docs.schema)
    kept.update(changed.union(new), spark.createDataFrame([(3,), (14,), (99_999,)], "doc_id long"))
    kept.update(docs.limit(0), spark.createDataFrame([(20_000,), (7,)], "doc_id long"))
    now = docs.where("doc_id % 7 <> 0 and doc_id <> 3").union(changed).union(new).where("doc_id not in (7, 20000)")
    fresh = lexical.LexicalIndex.build(now)

    def shape(index):
        weights = {(r.token, r.df, round(r.idf, 9)) for r in index.weights.collect()}
        return index.n, index.total, weights, sorted(map(tuple, index.postings.collect())), sorted(r.doc_id for r in index.docs.collect())

    def top(index):
        return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in lexical.bm25_top(index, asked, 10).collect())

    assert shape(kept.load()) == shape(fresh) and top(kept.load()) == top(fresh)
    kept.compact()
    assert shape(kept.load()) == shape(fresh) and top(kept.load()) == top(fresh)
    assert len(kept.retain(1)) == 3 and shape(kept.load()) == shape(fresh)


def test_live_postings_stay_where_they_are(spark, corpus, tmp_path):
    docs, _ = corpus
    kept = StoredIndex(spark, str(tmp_path / "index"))
    kept.rebuild(docs)
    kept.update(docs.limit(0), docs.where("doc_id < 9").select("doc_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = kept.load().postings
        plan = live._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and live.where("doc_id < 9").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_crash_leaves_the_index_as_it_was(spark, corpus, tmp_path, monkeypatch):
    docs, _ = corpus
    kept = StoredIndex(spark, str(tmp_path / "index"))
    kept.rebuild(docs)
    before = kept.load().n
    with pytest.raises(ValueError, match="repeated"):
        kept.update(spark.createDataFrame([(1, "a"), (1, "b")], docs.schema))

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(lexical, "directory", crash)
    with pytest.raises(OSError):
        kept.update(spark.createDataFrame([(30_000, "a b")], docs.schema))
    monkeypatch.undo()
    assert kept.load().n == before and kept.load().postings.where("doc_id = 30000").isEmpty()
    # An update that was made from an older state is refused.
    slow = StoredIndex(spark, kept.root)
    commit = slow.log.commit

    def late(change):
        kept.update(spark.createDataFrame([(30_001, "x")], docs.schema))
        return commit(change)

    slow.log.commit = late
    with pytest.raises(RuntimeError, match="another update"):
        slow.update(spark.createDataFrame([(30_002, "y")], docs.schema))
    assert kept.load().n == before + 1


def test_appends_of_two_writers_are_both_kept(spark, tmp_path):
    root = str(tmp_path / "t")
    first, second = VersionedTable(spark, root), VersionedTable(spark, root)
    first.promote(spark.range(1))
    errors = []

    def append(table, n):
        try:
            for _ in range(3):
                table.append(spark.range(n), n)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=append, args=(t, n)) for t, n in ((first, 4), (second, 10))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and first.read().count() == 1 + 12 + 30 and len(first.versions()) == 7
    with pytest.raises(ValueError):
        first.append(spark.range(3), 5)
    first.roll_back()
    assert first.read().count() in (33, 39)
    # A folder that no version names stays while it is young.
    spark.range(2).write.parquet(f"{root}/d{2**62}")
    first.retain(2)
    assert len(first.versions()) == 2 and f"d{2**62}" in first.log.names("d") and first.read().count() in (33, 39)


def test_a_dead_writers_number_is_taken_over(spark, tmp_path, monkeypatch):
    log = Versions(spark, str(tmp_path))
    monkeypatch.setattr(Versions, "PATIENCE", 0.3)
    log.commit(lambda s: s | {"a": 1})
    (tmp_path / "v000000000002").write_text("{")
    assert log.newest()[1] == {"a": 1}
    assert log.commit(lambda s: s | {"b": 2}) == "v000000000002" and log.newest()[1] == {"a": 1, "b": 2}


def test_files_are_replaced_at_once(spark, tmp_path, monkeypatch):
    files, path = Files(spark), str(tmp_path / "mark")
    files.write(path, "one")
    files.write(path, "two")
    assert files.read(path) == "two" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["mark"]
    lock = str(tmp_path / "lock")
    with files.lock(lock):
        with pytest.raises(RuntimeError):
            with files.lock(lock):
                pass
        # Left by a dead driver: taken over, and not released by the one that was taken for dead.
        with files.lock(lock, stale_after=-1):
            pass
    with files.lock(lock):
        assert files.exists(lock)
    assert not files.exists(lock)


def test_scratch_tables_of_threads_do_not_meet(spark):
    opened, written, done = threading.Event(), threading.Event(), threading.Event()
    out: dict = {}

    def first():
        with scratch(spark):
            stored(spark.range(2), "first")
            opened.set()
            written.wait(60)
        done.set()

    def second():
        opened.wait(60)
        out["table"] = stored(spark.range(5), "second")
        written.set()
        done.wait(60)
        out["rows"] = out["table"].count()

    threads = [threading.Thread(target=f) for f in (first, second)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert out["rows"] == 5
    dropped(out["table"])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def folders(spark):
    import os

    return Counter(n.rpartition("-")[0] for n in os.listdir(shared_dir(spark).removeprefix("file://")) if "-" in n)


@pytest.mark.parametrize("name", ["hybrid_search", "search_full", "bm25_topk", "index_after_deltas"])
def test_queries_leave_one_table(spark, name):
    import __spark_entry__ as entry

    before = folders(spark)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert sum((folders(spark) - before).values()) <= 1


def test_settled(spark):
    @settled
    def query(spark, n):
        return stored(spark.range(n), "inner").where("id > 0")

    before = folders(spark)
    assert query(spark, 4).count() == 3 and folders(spark) - before == Counter(["query"])
