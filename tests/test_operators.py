"""Operators on DataFrames: retrieval, merge, catalog, evaluation, sinks and streams."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexarium.operators import catalog, evaluate, merge, profile, retrieve
from lexarium.sources import readers, writers
from lexarium.streaming import incremental


def test_merge_semantics(spark):
    schema = "merge_key string, ticket_group string, text string, ingested_at string, pos int"
    base = spark.createDataFrame([("a", "t1", "x", "1", 0), ("b", None, "y", "1", 0), ("c", "t2", "z", "1", 0)], schema)
    new = spark.createDataFrame([("b", None, "y", "2", 1), ("c", "t2", "z", "2", 2), ("d", None, "p", "2", 3), ("d", None, "q", "2", 4)], schema)
    base, new = (d.withColumn("pos", F.lit(0)) if d is base else d for d in (base, new))
    drop = lambda d: d.drop("pos")
    merged, told = merge.merge(drop(base), new.withColumn("_order", F.col("pos")).drop("pos"), group="ticket_group", position="_order")
    kinds = sorted((r.merge_key, r.text, r.change) for r in told.collect())
    # Only ingest columns differ: unchanged. A replaced group's unchanged row is new. Two rows of one key: new, then updated.
    assert kinds == [("b", "y", "unchanged"), ("c", "z", "new"), ("d", "p", "new"), ("d", "q", "updated")]
    assert sorted((r.merge_key, r.text) for r in merged.collect()) == [("a", "x"), ("b", "y"), ("c", "z"), ("d", "q")]
    assert merge.delta(told).count() == 3


def test_purge_and_migrate(spark):
    df = spark.createDataFrame([(1, "a", "h.x.org"), (2, None, "y.org"), (3, "b", None)], "id int, dept string, host string")
    kept, counts = merge.purge(df, F.col("dept") == "a")
    assert [r.id for r in kept.collect()] == [2, 3] and tuple(counts.first()) == (3, 1, 2)
    moved = merge.migrate(df, "dept", "b", F.col("host").endswith(".x.org")).collect()
    assert [(r.dept, r.changed) for r in moved] == [("b", True), (None, False), ("b", False)]


def test_retrieval_small(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue cat"), (4, ""), (5, "green"), (6, "grey")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red"), (8, "nothing")], "query_id long, text string")
    top = retrieve.bm25_top(retrieve.LexicalIndex.build(docs), q, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in top] == [(7, 2), (7, 1), (7, 3), (8, 1), (8, 2), (8, 3)]
    assert [r.score for r in top[3:]] == [0.0, 0.0, 0.0]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id long, embedding array<float>")
    near = retrieve.knn(vec, spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, embedding array<float>"), 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in near] == [(2, 1.0), (3, 0.8)]
    many = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2)]) for i in range(20)] + [(99, None)], "query_id long, embedding array<float>")
    whole = sorted(tuple(r) for r in retrieve.knn(vec, many, 2).collect())
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 6)
    assert sorted(tuple(r) for r in retrieve.knn(vec, many, 2).collect()) == whole and len(whole) == 40
    run = lambda ids: spark.createDataFrame([(7, d, r) for r, d in enumerate(ids, 1)], "query_id long, doc_id long, rank int")
    fused = retrieve.fuse([(run([1, 2]), 1.0), (run([2, 3]), 1.0), (run([9]), 0.0)]).orderBy("fused_rank").collect()
    assert [r.doc_id for r in fused] == [2, 1, 3]
    once = retrieve.one_per_group(spark.createDataFrame([(7, 1, "t"), (7, 2, "t"), (7, 3, None), (7, 4, None)], "query_id long, rank int, g string"), "g", 3)
    assert [r["rank"] for r in once.orderBy("place").collect()] == [1, 3, 4]
    assert retrieve.pools(8)["semantic"] == 60 and retrieve.pools(8, short=True)["lexical"] == 120 and retrieve.overfetch(100) == 300


def test_rescue(spark):
    c = spark.createDataFrame([(1, 10, 0.5, 1)], "query_id long, doc_id long, fused_score double, seq int")
    lex = spark.createDataFrame([(1, d, r) for r, d in enumerate([11, 12, 13, 14, 15], 1)], "query_id long, doc_id long, rank int")
    holds = spark.createDataFrame([(1, 10), (1, 12), (1, 14), (1, 15)], "query_id long, doc_id long")
    assert sorted(r.doc_id for r in retrieve.exact_rescue(c, lex, holds).collect()) == [10, 12, 14]


def test_catalog(spark):
    cols = "source_type string, department string, ticket_id string, doc_id string, conversation_id string, chunk_id string, source string, subject string, page_title string, last_updated string, ingest_job_id string, ingested_at string, text string, position long"
    rows = [
        ("ticket", "d", "5", None, None, "c1", "", None, None, "2024-01-01 00:00:00", None, None, "a", 1),
        ("conversation", "d", "5", None, None, "c2", "https://www.a.org/?id=5", "Disk", None, "2024-02-01 00:00:00", "j", "2024-02-02 00:00:00", "b", 2),
        ("html", None, None, "doc", None, "c3", "https://www.a.org/x", None, "Title", None, None, None, "c", 3),
        ("pdf", "d", None, None, None, None, "", None, None, None, None, None, "d", 4),
    ]
    items = catalog.entries(spark.createDataFrame(rows, cols)).collect()
    by = {r.source_type: r for r in items}
    assert (by["ticket"].chunk_count, by["ticket"].title, by["ticket"].source, by["ticket"].host) == (2, "Disk", "https://www.a.org/?id=5", "www.a.org")
    assert by["web"].department == "unknown" and by["web"].title == "Title" and len(items) == 3
    df = catalog.entries(spark.createDataFrame(rows, cols))
    assert catalog.page(catalog.matching(df, q="disk"), 1, 10).first().total == 1
    assert {r.grp for r in catalog.tree(df).collect()} >= {"tickets", "a.org"}
    kids = catalog.tree_children(df).collect()
    assert len(kids) == 3 and {(r.grp, r.place) for r in kids} >= {("tickets", 1), ("a.org", 1)}
    buckets = catalog.overview_buckets(df, 1).collect()
    assert sorted((r.source_type, r.total, r.place) for r in buckets) == [("pdf", 1, 1), ("ticket", 1, 1), ("web", 1, 1)]
    assert catalog.lookup(df, by["web"].catalog_id).count() == 1 and catalog.lookup(df, "none").count() == 0
    assert by["ticket"].ingest_job_id == "j" and by["pdf"].ingest_job_id is None
    with pytest.raises(ValueError):
        catalog.page(df, 0, 10)


COLUMNS = "source_type string, department string, ticket_id string, doc_id string, conversation_id string, chunk_id string, source string, subject string, page_title string, last_updated string, ingest_job_id string, ingested_at string, text string, position long"


def chunk_rows(n, seed):
    """Rows of a few groups with missing titles, sources, jobs and times, in several forms of a time."""
    rng = random.Random(seed)
    times = [None, "", "2024-01-02", "2024-01-02T05:00:00+05:00", "2024-01-02 00:00:01", "2024-01-01T23:00:00Z", "2024-03-01 10:00:00"]
    pick = rng.choice
    return [
        (pick(["pdf", "web", "ticket"]), pick([None, "a"]), pick(["1", "2"]), pick(["x", "y"]), None, str(i), pick([None, "", f"https://h{i}.org/"]), pick([None, f"s{i}"]), pick([None, f"t{i}"]), pick(times), pick([None, None, f"j{i}"]), pick(times), "", i)
        for i in range(n)
    ]


def in_turn(rows):
    """Job and newest ingestion of each group, row after row in order of position."""
    utc = {"2024-01-02": "2024-01-02 00:00:00", "2024-01-02T05:00:00+05:00": "2024-01-02 00:00:00", "2024-01-01T23:00:00Z": "2024-01-01 23:00:00"}
    out = {}
    for r in sorted(rows, key=lambda r: r[-1]):
        key = (r[0], r[1] or "unknown", r[2] if r[0] == "ticket" else r[3])
        at = utc.get(r[11], r[11]) or ""
        job, top = out.get(key, (None, ""))
        out[key] = (r[10], at) if at > top else (r[10] if job is None else job, top)
    return sorted((k[0], k[1], job or "", top) for k, (job, top) in out.items())


@pytest.mark.parametrize("seed", range(2))
def test_catalog_states_follow_rows(spark, seed):
    rows = chunk_rows(90, seed)
    of = lambda some: spark.createDataFrame(some, COLUMNS)
    got = [(r.source_type, r.department, r.ingest_job_id or "", r.ingested_at or "") for r in catalog.entries(of(rows)).collect()]
    assert sorted(got) == in_turn(rows)
    # Rows behind the known ones, with and without rows that go, and rows between known ones.
    for known, added, removed in ((rows[:60], rows[60:], []), (rows[:60], rows[60:], rows[5:9]), (rows[::2], rows[1::2], rows[:1]), ([], rows, []), (rows, [], [])):
        now = [r for r in known if r not in removed] + added
        made = catalog.updated(catalog.states(of(known)), of(added), of(removed), of(now))
        assert sorted(map(repr, catalog.finished(made).collect())) == sorted(map(repr, catalog.entries(of(now)).collect()))
        assert sorted(map(repr, made.select(sorted(made.columns)).collect())) == sorted(map(repr, (t := catalog.states(of(now))).select(sorted(t.columns)).collect()))


def test_pages_by_cursor(spark, tmp_path):
    rows = [("web", f"d{i % 3}", None, f"doc{i}", None, None, "", None, f"Title {i % 7}", None, None, None, "", i) for i in range(57)]
    catalog.listed(catalog.entries(spark.createDataFrame(rows, COLUMNS))).write.parquet(str(tmp_path / "listing"))
    items = spark.read.parquet(str(tmp_path / "listing"))
    seen, after = [], None
    while page := catalog.page_after(items, 10, after).collect():
        seen += [r.catalog_id for r in page]
        after = tuple(page[-1].cursor)
    assert seen == [r.catalog_id for r in items.orderBy(*catalog.listing_order()).collect()] and len(seen) == 57
    for size, cursor in ((0, None), (101, None), (5, ("web",))):
        with pytest.raises(ValueError):
            catalog.page_after(items, size, cursor)


def test_evaluation(spark):
    res = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 6, 7], 1)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 6, 1), (1, 6, 2), (1, 9, 1)], "query_id long, doc_id long, grade int")
    m = evaluate.query_metrics(res, rel, 2).first()
    assert (m.precision, m.recall, m.mrr, m.top1, m.top3) == (0.5, 0.5, 0.5, 0, 1) and 0.6 < m.ndcg < 0.64
    groups = spark.createDataFrame([(1, "g"), (2, "g")], "query_id long, grp string")
    assert evaluate.group_agreement(res, groups, 3).first().agreement == 0.0


def test_floor_percentile(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 2, 9, 9]], "v int")
    assert tuple(profile.floor_percentile(df, "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}).first()) == (1, 3, 9, 9)
    assert tuple(profile.floor_percentile(df.limit(0), "v", {"a": 0.5}).first()) == (0,)


def test_versioned_table_and_stream(spark, tmp_path):
    table = writers.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = [(i, i % 5, datetime(2024, 1, 1 + i % 20), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.stream_upsert(stream, table, "user_id", "ts", "event_id", str(tmp_path / "ck"), "60 days").awaitTermination()
    want = {(r.user_id, r.event_id) for r in incremental.latest(df, "user_id", "ts", "event_id").collect()}
    assert {(r.user_id, r.event_id) for r in incremental.current(table, "user_id", "ts", "event_id").collect()} == want
    incremental.compact(table, "user_id", "ts", "event_id")
    assert table.read().count() == len(want)
    before = len(table.versions())
    for write in (table.promote, table.append):
        with pytest.raises(ValueError):
            write(df, rows=1)
    assert len(table.versions()) == before and table.read().count() == len(want)
    table.append(df.limit(1), rows=1)
    assert table.read().count() == len(want) + 1 and len(table.versions()) == before + 1
    table.roll_back()
    assert table.read().count() == len(want)
    table.append(df.limit(2))
    assert table.retain(1, apply=False) and len(table.versions()) == before + 1
    table.retain(1)
    assert len(table.versions()) == 1 and table.read().count() == len(want) + 2
    vectors = writers.VectorTable(spark, str(tmp_path / "vectors"))
    vectors.rebuild(spark.createDataFrame([("a", [1.0]), ("a", [1.0]), (None, [2.0]), ("b", None)], "doc_key string, embedding array<float>"))
    vectors.append(spark.createDataFrame([("a", [3.0]), ("c", [4.0])], "doc_key string, embedding array<float>"))
    assert sorted((r.doc_key, r.embedding[0]) for r in vectors.read().collect()) == [("a", 1.0), ("c", 4.0)]
    lower, upper = datetime(2024, 1, 2), datetime(2024, 1, 3)
    assert {r.ts.day for r in incremental.in_window(df, "ts", lower, upper).collect()} == {3}


def test_readers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"chunk_id": "1", "department": "bd", "text": " a "}\n\n{"chunk_id": "2", "text": ""}\n')
    rows = readers.jsonl_or_empty(spark, str(path))
    assert rows.count() == 2 and rows.where("department = 'bigdata'").count() == 1 and readers.documents(rows).count() == 1
    assert readers.jsonl_or_empty(spark, str(tmp_path / "none")).count() == 0
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.jsonl(spark, str(path)).collect()
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a.html").write_text("<title>Title</title><body><p>Some text</p></body>")
    docs = readers.html_documents(readers.html_files(spark, str(tmp_path / "site")).withColumnRenamed("path", "source")).first()
    assert docs.title == "Title" and docs.text == "Title\n\nSome text" and docs.extraction_status == "ok"
    writers.by_department(spark.createDataFrame([("a", 1), ("b", 2)], "department string, v int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
