"""Requests, variants, the search plan, stored indexes, snapshots and small files."""

from __future__ import annotations

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lexarium.functions import dates, ids
from lexarium.operators import evaluate, retrieve, rows, search
from lexarium.plans import surface
from lexarium.sources import readers, snapshots
from lexarium.sources.index_store import StoredIndex


def test_request_checks():
    got = search.request(" hi ", "02/01/2024", "2024-01-03T00:00:00Z", None, 5)
    assert got == search.Request("hi", date(2024, 1, 2), date(2024, 1, 3), "all", 5)
    for bad in (("", None, None), ("q", "2024-02-01", "2024-01-01"), ("q", "soon", None)):
        with pytest.raises(ValueError):
            search.request(*bad)
    with pytest.raises(ValueError):
        search.request("q", k=0)
    for bad in ("a$b", "ab", "x" * 33, "é"):
        with pytest.raises(ValueError, match="department"):
            search.request("q", department=bad)
    assert [search.request("q", department=d).department for d in ("Big Data", " ALL ", "", None, "new-one", "Systems")] == ["bigdata", "all", "all", "all", "new-one", "sistemas"]
    assert search.request("q", k=-1).k == 8 and search.request("", "2024-01-01", k=-1).k == -1
    assert search.request("", "2024-01-01", k=0).k == 0 and dates.filter_date(" ") is None
    assert [search.overfetch(8), search.overfetch(100), search.overfetch(400), search.overfetch(5, False)] == [32, 300, 400, 5]
    assert [search.next_overfetch(32, 8), search.next_overfetch(200, 8)] == [64, 300]


def test_department_filter_and_groups(spark):
    df = spark.createDataFrame([("BIG DATA", "bd"), ("bigdata", "all"), ("x", "a$b"), (None, ""), (None, "news")], "own string, wanted string")
    assert [r[0] for r in df.select(search.department_matches(F.col("own"), F.col("wanted"))).collect()] == [True, True, False, True, False]
    parts = [(5, None, None, None, "t"), (None, " c ", "s", "k", "t"), (None, None, "s", None, "t"), (None, None, None, "k", "t" * 100), (None, None, None, "k", "t" * 90)]
    keys = spark.createDataFrame(parts, "t bigint, c string, s string, k string, x string").select(search.group_key(*[F.col(c) for c in "tcskx"]))
    got = [r[0] for r in keys.collect()]
    assert got[:3] == ["ticket:5", "conversation:c", "source:s"] and got[3] == got[4] and got[3].startswith("fallback:")
    texts = spark.createDataFrame([("body", "Title", "html"), ("the title is", "Title", "pdf"), ("body", "Title", None), ("", "Title", "html")], "x string, t string, k string")
    assert [r[0] for r in texts.select(search.rerank_text(F.col("x"), F.col("t"), F.col("k"))).collect()] == ["Title\n\nbody", "the title is", "body", "Title"]


CHUNKS = "doc_id long, text string, department string, source_type string, last_updated string, page_title string, ticket_id bigint"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [
        (1, "alpha beta gamma", "sistemas", None, "2024-01-01 00:00:00", None, 1), (2, "alpha alpha delta", "bigdata", "html", "2024-02-01 00:00:00", "Alpha guide", None),
        (3, "beta delta", "sistemas", None, "2024-03-01 00:00:00", None, 1), (4, "molpro is here", "general", None, None, None, 2), (5, "epsilon", "general", "pdf", "2024-01-05 00:00:00", None, None),
        *((i, f"alpha filler{i} words", "general", None, "2024-01-02 00:00:00", None, 7) for i in range(6, 20)),
    ]

    def semantic(asked, k):
        ranked = spark.createDataFrame([(d, r) for r, d in enumerate(range(1, 20), 1)], "doc_id long, rank int")
        return asked.select("query_id", "variant").crossJoin(ranked.where(F.col("rank") <= k))

    return search.Corpus(spark.createDataFrame(docs, CHUNKS), semantic)


def ask(spark, corpus, *asked):
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "query_id bigint, text string, low date, high date, department string, k int")
    out: dict = {i: [] for i in range(len(asked))}
    for r in search.retrieve_batch(corpus, made).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.doc_id)
    return out, made


def test_search_plan(spark, corpus):
    got, made = ask(
        spark, corpus, ("alpha", None, None, "all", 5), ("alpha beta", None, None, "Systems", 5), ("alpha beta", date(2024, 2, 1), None, "all", 5), ("alpha", None, None, "a$b", 5),
        ("molpro", None, None, "all", 3), ("beta delta sistemas thing", None, None, "all", 3),
    )
    assert set(got[1]) == {1, 3}  # filtered by department
    assert got[2] == [3]  # in time, and no page
    assert got[3] == []  # an invalid filter finds nothing
    assert got[4][0] == 4  # the one token's bonus
    assert set(got[5][:2]) == {1, 3}  # the query names their department
    # One result a group; the many chunks of ticket 7 are one.
    grouped = [r for r in search.search_batch(corpus, made).orderBy("query_id", "rank").collect() if r.query_id == 0]
    assert len({r.group_key for r in grouped}) == len(grouped) == 5 and [r["rank"] for r in grouped] == [1, 2, 3, 4, 5]
    dated = search.date_batch(corpus.chunks, search.request("", "2024-01-01", None, "all", 0)).collect()
    assert [r.doc_id for r in dated] == [3, 6]
    # What is no number of results is the default one.
    few, _ = ask(spark, corpus, ("alpha", None, None, "all", 0), ("alpha", None, None, "all", -2), ("alpha", None, None, "all", None))
    assert [len(v) for v in few.values()] == [8, 8, 8]


def test_names_of_departments_agree(spark):
    names = ["BIG DATA", "big__data", "a/b c", "ab", "-x-y-", "é", "a$b", "x" * 33, "Systems", " slurm ", "", "a" * 32, "_", "bd"]
    df = spark.createDataFrame([(n,) for n in names], "x string").select(ids.valid_department(F.col("x")))
    assert [r[0] for r in df.collect()] == [ids.valid_name(n) for n in names]


def test_variants_of_a_batch(spark, corpus):
    asked = spark.createDataFrame([(1, "alpho guide"), (2, "what is beta")], "query_id bigint, text string")
    got = {(r.query_id, r.text) for r in search.query_variants(asked, corpus.vocabulary()).collect()}
    assert {(1, "alpho guide"), (1, "alpha guide"), (2, "beta overview")} <= got


def test_stored_index(spark, corpus, tmp_path):
    kept = StoredIndex(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        kept.load()
    docs = corpus.chunks.select("doc_id", "text")
    kept.rebuild(docs)
    kept.rebuild(docs)
    kept.rebuild(docs)
    q = spark.createDataFrame([(1, "alpha beta")], "query_id bigint, text string")
    rows_ = lambda index: [tuple(r) for r in retrieve.bm25_top(index, q, 5).orderBy("rank").collect()]
    assert rows_(kept.load()) == rows_(corpus.index) and len(kept.log.names("v")) == len(kept.log.names("s")) == 2


def test_small_files(spark, tmp_path):
    files = snapshots.Files(spark)
    path = str(tmp_path / "s.json")
    files.write_json(path, {"a": "é", "at": datetime(2024, 1, 2, 3), "b": b"x"})
    files.write_json(path, {"a": "é", "at": datetime(2024, 1, 2, 3), "b": b"x"})
    assert files.read_json(path) == {"a": "é", "at": "2024-01-02 03:00:00", "b": "x"} and files.stamp(path)["bytes"] > 10 and files.stamp(path + "x") is None
    one = spark.range(1).select(F.lit(2).alias("rows"), F.lit(0.5).alias("in_range_pct"))
    assert snapshots.summary(files, path, one) == {"rows": 2, "in_range_pct": 0.5}
    assert "- in range pct: 50.00%" in snapshots.report(files, str(tmp_path / "r.md"), "Quality", one)
    with pytest.raises(ValueError):
        snapshots.summary(files, path, spark.range(2))
    mark = snapshots.Watermark(files, str(tmp_path / "mark"))
    assert mark.get() is None
    with pytest.raises(ValueError):
        mark.commit(None)
    with pytest.raises(ZeroDivisionError):
        mark.run(datetime(2024, 1, 1), lambda: 1 / 0)
    assert mark.get() is None
    mark.run(datetime(2024, 1, 1), lambda: None)
    assert mark.get() == datetime(2024, 1, 1)
    with files.lock(str(tmp_path / "lock")):
        with pytest.raises(RuntimeError):
            with files.lock(str(tmp_path / "lock")):
                pass
    with files.lock(str(tmp_path / "lock")):
        pass
    tries, waits = [], []

    def job():
        tries.append(1)
        if len(tries) < 2:
            raise OSError
        return "done"

    assert snapshots.retried(job, 1, 300, waits.append) == "done" and waits == [300]
    with pytest.raises(OSError):
        snapshots.retried(lambda: files.read(str(tmp_path / "none")) and None if False else (_ for _ in ()).throw(OSError()), 1, 0, waits.append)


def test_settings():
    assert snapshots.Settings.of({}) == snapshots.Settings()
    got = snapshots.Settings.of({"retrieval": {"semantic_k": "64", "use_faiss_cache": "no", "unknown": 1}, "fusion": {"rrf_k": 50}, "index_backups": {"keep_last": -3, "enabled": None}})
    assert (got.semantic_k, got.use_index, got.rrf_k, got.backups_kept, got.backups_enabled) == (64, False, 50, 0, True)
    assert [snapshots.truth(v) for v in ("Yes", 0, None, "maybe", True)] == [True, False, False, False, True]


def test_ingest_requests(spark):
    assert snapshots.ingest_request(" a b ", 20, 0, True) == "a b" and snapshots.ingest_request() is None and snapshots.ingest_request(" ") is None
    for bad in ({"label": "a/b"}, {"label": ""}, {"label": "x" * 121}, {"depth": 0}, {"depth": 21}, {"overlap_hours": 169}, {"confirm": False}):
        with pytest.raises(ValueError):
            snapshots.ingest_request(**bad)
    names = spark.createDataFrame([("BIG DATA",)], "x string")
    assert names.select(ids.required_department(F.col("x"))).first()[0] == "bigdata"
    with pytest.raises(Exception, match="invalid department"):
        names.select(ids.required_department(F.lit("a$b"))).collect()


def test_catalog_snapshot(spark, tmp_path):
    data = tmp_path / "data.jsonl"
    data.write_text('{"a": 1}\n\n')
    assert readers.count_rows(spark, str(data)) == 1 and readers.count_rows(spark, str(tmp_path / "no")) == 0
    names = "source_type department ticket_id doc_id conversation_id chunk_id source subject page_title last_updated ingest_job_id ingested_at text"
    given = spark.createDataFrame([("ticket", "d", "5", *[None] * 9, "x", 1)], ", ".join(f"{n} string" for n in names.split()) + ", position bigint")
    kept = snapshots.CatalogSnapshot(spark, str(tmp_path / "catalog"))
    assert kept.stale(str(data))
    assert kept.load_or_rebuild(str(data), lambda: given).count() == 1 and not kept.stale(str(data))
    assert kept.load_or_rebuild(str(data), lambda: 1 / 0).count() == 1
    data.write_text('{"a": 1, "b": 2}\n')
    assert kept.stale(str(data)) and not kept.stale(str(tmp_path / "gone"))
    kept.files.write(kept.side, "{broken")
    assert kept.stale(str(data))


def test_readers_more(spark, tmp_path):
    df = spark.createDataFrame([(" a ", None, "l", "2024", "bd", "c1"), ("", "s", None, None, None, None)], "text string, source string, link string, lastUpdated string, department string, chunk_id string")
    got = readers.documents(df).collect()
    assert len(got) == 1 and (got[0].text, got[0].source, got[0].last_updated, got[0].department, got[0].chunk_id, got[0].page_title) == ("a", "l", "2024", "bigdata", "c1", None)
    for n in "ba":
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.html").write_text("<p>t</p>")
    assert readers.html_files(spark, str(tmp_path), 1).first().path.endswith("a/x.html")
    assert tuple(readers.tree_statistics(spark, str(tmp_path)).first()) == (2, 2, 16)
    tickets = spark.createDataFrame([(1, datetime(2024, 1, 2), "q"), (2, datetime(2024, 1, 3), "q"), (3, datetime(2024, 1, 2), "z"), (4, datetime(2024, 1, 1), "q")], "id long, LastUpdated timestamp, Queue string")
    steps = spark.createDataFrame([(9, 1, "RT::Ticket", "Create", datetime(2024, 1, 1), 1), (8, 1, "RT::Ticket", "Comment", datetime(2024, 1, 1), 2)], "id long, ObjectId long, ObjectType string, Type string, Created timestamp, Creator long")
    files = spark.createDataFrame([(1, 9, ""), (2, 9, "first"), (3, 9, "second"), (4, 8, "note")], "id long, TransactionId long, Content string")
    people = spark.createDataFrame([(1, "x@ORG.es")], "id long, EmailAddress string")
    made = readers.tickets_with_messages(tickets, steps, files, people, "2024-01-01 00:00:00", "2024-01-03 00:00:00", "org", ["q"]).orderBy("place").collect()
    assert [(r.id, r.place) for r in made] == [(1, 1), (2, 2)] and [(m.role, m.content) for m in made[0].messages] == [("comment", "note"), ("assistant", "first")] and made[1].messages is None
    plain = readers.tickets_with_messages(tickets, steps, files, people, "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    assert {r.id for r in plain.collect()} == {1, 2, 3}
    with_status = tickets.withColumn("Status", F.when(F.col("id") == 2, "resolved").otherwise("open"))
    resolved = readers.tickets_with_messages(with_status, steps, files, people, "2024-01-01 00:00:00", "2024-01-03 00:00:00", statuses=["resolved"])
    assert [r.id for r in resolved.collect()] == [2]


def test_tickets_with_large_keys(spark, tmp_path):
    day, c = datetime(1995, 5, 5), duckdb.connect()
    given = {
        "orders": ([(1, day, "2-HIGH"), (2, day, "2-HIGH")], "o_orderkey long, o_orderdate timestamp, o_orderpriority string"),
        # As one number, the lines of order 1 would be one, and those of order 2 would change places.
        "lineitem": ([(1, 3, 1_000_005, 1, day), (1, 4, 5, 1, day), (2, 3, 1_900_000, 1, day), (2, 4, 7, 1, day)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp"),
        "supplier": ([(1, "s")], "s_suppkey long, s_name string"),
    }
    for name, rows in given.items():
        spark.createDataFrame(*rows).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(c.sql(surface.TICKETS).fetchall())
    assert sorted(map(tuple, surface.tickets_with_messages(spark, str(tmp_path)).collect())) == want and len(want) == 2


def test_row_builders(spark):
    pages = spark.createDataFrame([("https://x/a.pdf", "2024-01-02", None, "Head line\n" + "t" * 50, 2, 3), ("s", "2024-01-02", "ok", "t" * 50, 1, None)], "source string, extracted_at string, extraction_status string, text string, page int, total_pages int")
    good, skipped = rows.pdf_rows(pages, "general")
    r = good.first()
    assert (r.link, r.page_title, r.page_label, r.ingested_at) == ("https://x/a.pdf#page=2", "Head line", "page_002", "2024-01-02 00:00:00") and r.messages[0].role == "assistant"
    assert [tuple(x) for x in skipped.collect()] == [("invalid total pages", 1)]
    assert rows.deduped(good.union(good)).count() == 1
    files = spark.createDataFrame([("/a/Big_Data.x",), ("/sistemas/none",)], "p string")
    assert [x[0] for x in files.select(rows.file_department(F.col("p"))).collect()] == ["bigdata", None]
    with pytest.raises(Exception, match="no department"):
        files.select(rows.known_file_department(F.col("p"))).collect()
    given = spark.createDataFrame([("c", "old", "old_chunk_7", "t"), ("c", "c", "c_chunk_1", "t"), ("c", None, None, "t")], "conv string, orig string, chunk string, text string")
    ids_ = [x[0] for x in given.select(rows.chunk_id(F.col("text"), F.col("conv"), F.col("orig"), F.col("chunk"))).collect()]
    assert ids_[:2] == ["c_chunk_7", "c_chunk_1"] and ids_[2].startswith("c_chunk_") and len(ids_[2]) == 18
    conv = spark.createDataFrame([(" c ", "s", "t"), (None, "u?id=4", "t"), (None, None, "t")], "c string, s string, t string").select(ids.stable_conversation_id(F.col("c"), F.col("s"), F.col("t")))
    got = [x[0] for x in conv.collect()]
    assert got[:2] == ["c", "conv_4"] and len(got[2]) == 17


def test_relevance(spark):
    rows_ = [(1, " 5 ", ["6", "x"], None, [" a "], [("5", None, "3"), (None, "b", "bad"), ("7", None, "-1"), (None, None, "2")]), (2, None, None, "", None, None)]
    got = {(r.query_id, r.identity): r.grade for r in evaluate.expected_relevance(spark.createDataFrame(rows_, evaluate.EXPECTED)).collect()}
    assert got == {(1, "ticket:5"): 3.0, (1, "ticket:6"): 1.0, (1, "conversation:a"): 1.0, (1, "conversation:b"): 1.0, (1, "ticket:7"): 0.0}


def test_purge_and_run_log(spark, tmp_path):
    from lexarium.sources.writers import VersionedTable

    kept = VersionedTable(spark, str(tmp_path / "rows"))
    kept.promote(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, department string"))
    hit = F.col("department") == "a"
    assert snapshots.purged(kept, hit) == {"before": 3, "removed": 1, "after": 2, "dry_run": True} and kept.read().count() == 3
    log = snapshots.RunLog(spark, str(tmp_path / "log"))
    assert log.run("purge", lambda: snapshots.purged(kept, hit, dry_run=False))["after"] == 2 and kept.read().count() == 2
    with pytest.raises(ZeroDivisionError):
        log.run("broken", lambda: 1 / 0)
    assert sorted((r.job, r.state) for r in log.read().collect()) == [("broken", "failed"), ("purge", "done")]
