"""Clustered layout, filter audit and WARC archives against plain forms of their definitions, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zipfile
import zlib
from collections import defaultdict
from io import BytesIO
from itertools import permutations

import pytest

SF = "/root/testdata/sf0.001"


def sql(name: str, **tables):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toArrow())
    return con.sql(entry.oracle_sql()[name])


def same_rows(df, want) -> None:
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


DOCS = "doc_id long, text string, lang string, source string, z int, file string, part string, mask int, position long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "f", "p", 3, 9) for r in rows], DOCS)


# ---- 11 -------------------------------------------------------------------------------------------------------


def layout(rows, file_rows, reach):
    """(doc_id, z, position, file, touched, matching, bounds) of rows (doc_id, source, lang, length, date)."""
    n, key = len(rows), lambda v: (v is not None, v)
    coords = []
    for r in rows:
        coords.append([16 * sum(key(o[k]) < key(r[k]) for o in rows) // n for k in range(1, 5)])
    zs = []
    for s, lang, length, date in coords:
        zs.append(int("".join(f"{length:04b}"[b] + f"{s:04b}"[b] + f"{date:04b}"[b] + f"{lang:04b}"[b] for b in range(4)), 2))
    order = sorted(range(n), key=lambda i: (zs[i], key(rows[i][0])))
    files = [order[i : i + file_rows] for i in range(0, n, file_rows)]
    box = [[(min(coords[i][k] for i in f), max(coords[i][k] for i in f)) for k in range(4)] for f in files]
    out = []
    for p, i in enumerate(order):
        c = coords[i]
        touched = sum(all(hi >= c[k] - reach[k] and lo <= c[k] + reach[k] for k, (lo, hi) in enumerate(b)) for b in box)
        matching = sum(any(all(abs(coords[j][k] - c[k]) <= reach[k] for k in range(4)) for j in f) for f in files)
        out.append((rows[i][0], zs[i], p, p // file_rows, touched, matching, ",".join(f"{lo},{hi}" for lo, hi in box[p // file_rows])))
    return sorted(map(repr, out))


def test_layout_equals_its_definition(spark):
    from lexarium.llm import clustered_layout as op

    rng = random.Random(4)
    rows = [
        (None if i % 50 == 7 else i, rng.choice([None, "", "a", "é", "z", "zz", *["hot"] * 6]), rng.choice([None, "en", "de", "fr"]), rng.choice([-1, 0, 3, rng.randrange(900)]), None if i % 50 == 7 else rng.randrange(365))
        for i in range(300)
    ]
    rows += rows[20:25]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, length long, date long")
    got = op.clustered(df.withColumn("key", df.lang), op.REACH, op.ROUND, file_rows=20)
    assert sorted(map(repr, map(tuple, got.collect()))) == layout(rows, 20, [0, 0, 2, 2])
    # One value, and one row everywhere.
    for odd in ([(1, "s", "en", 5, 3)] * 9, [(None, None, None, -1, None)]):
        got = op.clustered(spark.createDataFrame(odd, df.schema), op.REACH, op.ROUND, file_rows=4)
        assert sorted(map(repr, map(tuple, got.collect()))) == layout(odd, 4, [0, 0, 2, 2])
    assert op.clustered(df.limit(0), op.REACH, op.ROUND).count() == 0


def test_layout_of_odd_documents(spark):
    from lexarium.llm import clustered_layout as op

    docs = docs_of(spark, [(None, None, None, None), (5, "", "en", "s"), (5, "", "en", "s"), (-3, "é" * 50_000, "de", None), (10**12, "a", None, "t")])
    got = {r.doc_id: r for r in op.document_dimensions(docs).collect()}
    assert got[None].length == -1 and got[None].date is None and got[-3].length == 100_000
    assert all(r.date == zlib.crc32(str(i).encode()) % 365 for i, r in got.items() if i is not None)
    assert sorted(r.position for r in op.clustered(op.document_dimensions(docs), op.REACH, op.ROUND).collect()) == [0, 1, 2, 3, 4]


def test_interleaving_goes_back(spark):
    from lexarium.llm import clustered_layout as op

    df = spark.createDataFrame([(0, 0, 0, 0), (15, 15, 15, 15), (1, 2, 4, 8), (9, 3, 12, 6)], "length int, source int, date int, lang int")
    z = df.withColumn("z", op.interleaved({d: d for d in op.ROUND}, op.ROUND))
    back = z.select(*op.ROUND, *(op.coordinate_in("z", d, op.ROUND).alias(f"{d}_") for d in op.ROUND)).collect()
    assert all(tuple(r)[:4] == tuple(r)[4:] for r in back)


def test_layout_equals_its_sql(spark):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same_rows(entry.queries()["op11_clustered_layout"](spark, SF), sql("op11_clustered_layout", documents=docs))


# ---- 12 -------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    """Every row through every order of the filters by itself."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = defaultdict(lambda: [0] * 6)
    for i, t, source in rows:
        t, part = t or "", source or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and t in first and i > first[t],
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                now = out[part, "".join(order), step]
                hit = fails[x] and not gone
                now[0] += not gone and not fails[x]
                now[1] += hit
                now[2] += fails[x] and gone
                now[3] += fails[x] and sum(fails.values()) == 1
                now[4] += hit and i in good
                now[5] += hit and i in toxic
                gone = gone or fails[x]
    share = defaultdict(int)
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] += v[1]
    return sorted(repr((*k, *map(int, v), share[k[0], k[1][k[2] - 1]])) for k, v in out.items())


def test_audit_equals_its_definition(spark):
    from lexarium.llm import filter_audit as op

    rng = random.Random(8)
    pool = [None, "", " \t", "É#", "A" * 30, "word " * 80, " ".join(f"w{i}" for i in range(70)), "Big " + " ".join(f"x{i}" for i in range(60)), "a$ " * 50, "x" * 100_000]
    rows = [(i, rng.choice(pool), rng.choice([None, "", "s", "t", "hot", "hot"])) for i in range(120)]
    rows += [(None, "word " * 80, "s"), (None, "only here", "n"), rows[3], rows[3], (rows[3][0], "another text", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    docs = docs_of(spark, [(i, t, "en", s) for i, t, s in rows])
    known = spark.createDataFrame([(*x, "n", 1) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    got = op.audit(docs, known)
    assert sorted(map(repr, map(tuple, got.collect()))) == audited(rows, labels)
    assert op.audit(docs.limit(0), known).count() == 0
    alone = op.audit(docs.limit(1), known.limit(0)).collect()
    assert len(alone) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in alone)
    same_rows(got, sql("op12_filter_audit", documents=docs, labels=known))


def test_audit_equals_its_sql(spark):
    import __spark_entry__ as entry

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    same_rows(entry.queries()["op12_filter_audit"](spark, SF), sql("op12_filter_audit", documents=docs, labels=labels))


# ---- 13 -------------------------------------------------------------------------------------------------------


@pytest.fixture
def home(tmp_path):
    return f"file://{tmp_path}/archives"


PAGES = "page_id long, url string, html string, path string, start long, response long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], PAGES)


def test_warc_round_trip(spark, home):
    from lexarium.llm import warc_zip as op

    big, big2, short = "é" * 600, "x" * 1000, "y" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/\r\n2", big), (3, None, big), (4, "u", short), (5, "u", short), (6, "", None), (7, "u", ""), (8, "u", "z" * 3_000_000)]
    rows += [(9, "u", big2), (9, "u", big2), (None, "u", big2), (None, "u", "lone" * 300), (11, "u", "WARC/1.1\r\n\r\n" * 200), (12, "u", "\0\x1f\x8b" * 500)]
    pages = pages_of(spark, rows).repartition(3)
    archives = op.write_archives(pages, home, archive_bytes=1000)
    listed = archives.collect()
    assert sum(a.records for a in listed) == len(rows) and len(listed) > 2
    read = op.read_records(op.places(archives)).collect()
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        last = max((j for j, _, o in rows if j is not None and o == t), default=None) if len(b) >= 1000 else None
        kind = last is not None and i != last
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if kind else "response", last if kind else None, None if kind else b))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in read]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r.url for r in read if r.page_id in (2, 3, 6)} == {"http://a/%0D%0A2", None, ""}
    # Any subset can be read alone; members are listed without a look into them.
    one = op.read_records(op.places(archives).where("bytes > 3000")).collect()
    assert [r.page_id for r in one] == [8]
    assert {m.member for m in op.members(archives).collect()} == {op.DATA, op.INDEX}
    with zipfile.ZipFile(listed[0].path.removeprefix("file://")) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert op.write_archives(pages.limit(0), home).count() == 0


def test_warc_equals_its_sql(spark):
    import os

    import __spark_entry__ as entry

    from lexarium.llm.common import shared_dir

    pages, shared = spark.read.parquet(f"{SF}/pages.parquet"), shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    same_rows(entry.queries()["op13_warc"](spark, SF), sql("op13_warc", pages=pages))
    assert [n.rpartition("-")[0] for n in set(os.listdir(shared)) - before] == ["warc-read"]


def plain_zip(names, comment=b"", before=b"", wide=False):
    """A stored archive written byte by byte; ``wide`` puts every size and place into ZIP64 fields."""
    out, entries = BytesIO(), []
    for name, data in names:
        n, at = name.encode(), out.tell()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out.write(struct.pack("<4s5HLLLHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(data), *((0xFFFFFFFF,) * 2 if wide else (len(data),) * 2), len(n), len(extra)) + n + extra + data)
        extra = struct.pack("<HH", 0x5455, 1) + b"x" + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        sizes = (0xFFFFFFFF,) * 2 if wide else (len(data),) * 2
        entries.append(struct.pack("<4s6HLLL5HLL", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(data), *sizes, len(n), len(extra), 2, 0, 0, 0, 0xFFFFFFFF if wide else at) + n + extra + b"hi")
    at, raw = out.tell(), b"".join(entries)
    out.write(raw)
    if wide:
        end = out.tell()
        out.write(struct.pack("<4sQHHLLQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(names), len(names), len(raw), at))
        out.write(struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
        out.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment)
    else:
        out.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(names), len(names), len(raw), at, len(comment)) + comment)
    return before + out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 is not the end" + b"c" * 60_000])
def test_zip_directories(wide, comment):
    from lexarium.llm import warc_zip as op

    names = [("archive/a.warc", b"first"), ("é/ü", b""), ("x", b"PK\5\6" + b"0" * 30), *((f"n{i}", bytes([i % 256])) for i in range(500))]
    raw = plain_zip(names, comment, b"" if wide else b"#!/bin/sh\n", wide)
    found = op.directory(BytesIO(raw), len(raw))
    assert [(n, raw[s : s + z]) for n, _, s, z in found] == names
    with pytest.raises(ValueError):
        op.directory(BytesIO(raw[: len(raw) // 3]), len(raw) // 3)
    with pytest.raises(ValueError):
        op.directory(BytesIO(b""), 0)


def test_foreign_archives(spark, tmp_path):
    """Without an index records are walked, compressed one by one or not; archives compressed as a whole raise."""
    import gzip

    from lexarium.llm import warc_zip as op

    def rec(i, text, pack):
        raw = op.record(i, f"http://h/{i}", text, hashlib.sha1(text).hexdigest(), len(text), None, False)
        return gzip.compress(raw) if pack else raw

    texts = [b"", b"one", b"WARC/1.1\r\n" * 20_000, b"two" * 1000]
    for pack in (False, True):
        data = b"".join(rec(i, t, pack) for i, t in enumerate(texts))
        (tmp_path / f"{pack}.wacz").write_bytes(plain_zip([("datapackage.json", b"{}"), ("archive/a.warc.gz" if pack else "archive/a.warc", data), ("archive/b.warc", rec(9, b"nine", False))], b"note", wide=pack))
        archives = spark.createDataFrame([(f"file://{tmp_path}/{pack}.wacz",)], "path string")
        read = op.read_records(op.places(archives)).collect()
        assert sorted((r.page_id, bytes(r.payload)) for r in read) == [*enumerate(texts), (9, b"nine")]
        assert {r.url for r in read} == {f"http://h/{i}" for i in (0, 1, 2, 3, 9)}
    with zipfile.ZipFile(tmp_path / "packed.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", rec(1, b"x" * 500, False))
    packed = spark.createDataFrame([(f"{tmp_path}/packed.wacz",)], "path string")
    assert [m.method for m in op.members(packed).collect()] == [8]
    with pytest.raises(Exception, match="not stored"):
        op.places(packed).collect()


def test_a_changed_payload_is_noticed():
    from lexarium.llm import warc_zip as op

    raw = op.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None, False)
    assert op.parsed(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        op.parsed(raw.replace(b"payload", b"PAYLOAD"))
    with pytest.raises(ValueError):
        op.parsed(raw[3:])
