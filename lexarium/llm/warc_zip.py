"""WARC records in ZIP archives: tasks write archives, others find members by the ZIP directories and range-read records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import scratch, shared_dir, stored, table
from lexarium.storage import deleted

#: Payloads of this many bytes or more are written once and revisited.
REVISIT_BYTES = 1000
#: An archive is closed when it holds so many bytes; a task writes as many archives as its rows need.
ARCHIVE_BYTES = 64 << 20
#: Bytes that a reader asks for at once when neighbouring records are wanted.
READ_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"
# Signatures and sizes of the ZIP format's structures.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1

ARCHIVES = "path string, bytes bigint, records bigint"
MEMBERS = "path string, member string, method int, start bigint, bytes bigint"
PLACES = "path string, start bigint, bytes bigint"
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, "
    "path string, start bigint, bytes bigint"
)
PLACES_OUT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("bytes", pa.int64())])
MEMBERS_OUT = pa.schema([("path", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("start", pa.int64()), ("bytes", pa.int64())])
RECORDS_OUT = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("payload", pa.binary()), ("path", pa.string()), ("start", pa.int64()), ("bytes", pa.int64())]
)


def files(home: str):
    """The file system and path of a folder's URI (``file``, ``hdfs``, ``s3`` and others that Arrow opens; no scheme: a local path)."""
    from pyarrow import fs

    if "://" not in home:
        return fs.LocalFileSystem(), home.removeprefix("file:")
    return fs.FileSystem.from_uri(home.replace("s3a://", "s3://", 1))


# ---- records ----------------------------------------------------------------------------------------------------


def head(lines: list[tuple[str, str]]) -> bytes:
    """Header lines; what would end a line is percent-encoded."""
    shown = (f"{k}: {''.join(c if c >= ' ' and c != chr(127) else f'%{ord(c):02X}' for c in v)}\r\n" for k, v in lines)
    return "".join(shown).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit keeps the response's head, whose Content-Length tells the full payload's size."""
    http = b"HTTP/1.1 200 OK\r\n" + head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + b"\r\n"
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    lines += [("WARC-Target-URI", url)] if url is not None else []
    lines += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if revisit:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + head(lines) + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parsed(raw: bytes) -> dict:
    """A record's fields; a response's payload is checked against its digest."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    top, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(top)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = h["warc-type"] == "revisit"
    size = int(headers(http)["content-length"])
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {h['warc-record-id']} is not what its digest says")
    return {
        "page_id": page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


# ---- writing ----------------------------------------------------------------------------------------------------


def decided(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, and what they revisit: of equal payloads of 1000 bytes or more the largest page_id is the response.

    Payloads compare by SHA-256. Only payloads that occur again are joined to the pages, one row each, so a payload that many pages
    have is a long side of a join that can be split. Pages that revisit lose their payload before it reaches a task of Python.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    size = F.length(html).cast("long")
    big = pages.where(size >= REVISIT_BYTES).groupBy(F.unhex(F.sha2(html, 256)).alias("same")).agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    big = big.where("n > 1 and response is not null").select("same", "response")
    own = F.when(size >= REVISIT_BYTES, F.unhex(F.sha2(html, 256)))
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"), size.alias("size"), own.alias("own"))
    rows = rows.join(big, rows.own == big.same, "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))


class Archive:
    """A ZIP archive being written: a stored member of compressed records, then a stored index of their places in it."""

    def __init__(self, home: str):
        fs, folder = files(home)
        self.path, self.at, self.lines = f"{home}/{uuid.uuid4().hex}.wacz", 0, []
        self.out = fs.open_output_stream(f"{folder}/{self.path.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        # Members are streamed, so their sizes are not known when they begin: room for ZIP64 sizes is kept.
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, row: dict) -> None:
        raw = gzip.compress(record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["size"], row["refers_to"], row["revisit"]), 4, mtime=0)
        self.member.write(raw)
        self.lines.append(json.dumps({"page": row["page_id"], "offset": self.at, "length": len(raw), "digest": row["digest"]}))
        self.at += len(raw)

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in self.lines))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return {"path": self.path, "bytes": size, "records": len(self.lines)}


def write_archives(pages: DataFrame, home: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC records in ZIP archives in the shared folder ``home``; returns their list.

    The list ``(path, bytes, records)`` is a stored table: archives of tasks that failed or ran twice are in no list and are not read. A task closes
    an archive at ``archive_bytes`` and holds one record and its index lines in memory. A null html is an empty payload, a null url no target, a null page_id an
    empty record id that revisits but is never the response of others; of repeated rows of one page_id all are responses.
    Further columns are ignored; an empty table writes no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            for i in range(b.num_rows):
                archive = archive or Archive(home)
                archive.add({name: b.column(name)[i].as_py() for name in b.schema.names})
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        done += [archive.close()] if archive else []
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    fs, folder = files(home)
    fs.create_dir(folder, recursive=True)
    return stored(decided(pages.select("page_id", "url", "html")).mapInArrow(run, ARCHIVES), "warc-archives")


# ---- reading ----------------------------------------------------------------------------------------------------


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """``(name, method, first byte, bytes)`` of each member of an open ZIP file, by its directories alone.

    The end record is looked for behind a comment of any length; where it is full, the ZIP64 end record takes its place, and full
    fields of an entry stand in its ZIP64 extra. Bytes before the archive shift nothing: places count from the directory back.
    """
    tail_at = max(0, size - END_SIZE - FULL16 - LOCATOR64_SIZE)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and len(tail) - at >= END_SIZE and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0 or len(tail) - at < END_SIZE:
        raise ValueError("no ZIP archive: it has no end record")
    count, length, start = struct.unpack_from("<10xHLL", tail, at)
    end = tail_at + at
    if count == FULL16 or FULL32 in (length, start):
        sign, where = struct.unpack_from("<4s4xQ", tail, at - LOCATOR64_SIZE) if at >= LOCATOR64_SIZE else (b"", 0)
        if sign == LOCATOR64:
            f.seek(where)
            raw = f.read(END64_SIZE)
            if raw[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<32xQQQ", raw)
            end = where
    before = end - length - start
    f.seek(start + before)
    raw, at, out = f.read(length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("the central directory is cut short")
        method, packed, plain, n, m, k, local = struct.unpack_from("<10xH8xLLHHH8xL", raw, at)
        name = raw[at + ENTRY_SIZE : at + ENTRY_SIZE + n].decode("utf-8", "replace")
        extra, e = raw[at + ENTRY_SIZE + n : at + ENTRY_SIZE + n + m], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == EXTRA64:
                # Only full fields stand here, in this order.
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            e += 4 + width
        out.append((name, method, local + before, packed))
        at += ENTRY_SIZE + n + m + k
    found = []
    for name, method, local, packed in out:
        f.seek(local)
        raw = f.read(LOCAL_SIZE)
        if raw[:4] != LOCAL:
            raise ValueError(f"{name}: no local header where the directory points")
        n, m = struct.unpack_from("<26xHH", raw)
        found.append((name, method, local + LOCAL_SIZE + n + m, packed))
    return found


def members(archives: DataFrame) -> DataFrame:
    """The members of each archive of ``archives(path)``: name, compression method, first byte and bytes in the archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = files(path)
                with fs.open_input_file(at) as f:
                    found = directory(f, f.size())
                yield pa.RecordBatch.from_pylist([{"path": path, "member": n, "method": m, "start": s, "bytes": z} for n, m, s, z in found], schema=MEMBERS_OUT)

    return archives.select("path").mapInArrow(run, MEMBERS)


def walked(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """``(start, bytes)`` of the records of a member without an index: compressed ones end where their stream ends, others by their length."""
    at, end = start, start + size
    while at < end:
        f.seek(at)
        first = f.read(min(1 << 16, end - at))
        if first[:2] == b"\x1f\x8b":
            z, used, chunk = zlib.decompressobj(31), 0, first
            while chunk and not z.eof:
                z.decompress(chunk)
                used += len(chunk)
                chunk = b"" if z.eof else f.read(min(1 << 16, end - at - used))
            used -= len(z.unused_data)
            if not z.eof:
                raise ValueError("a compressed record is cut short")
        else:
            while b"\r\n\r\n" not in first and at + len(first) < end:
                first += f.read(min(1 << 16, end - at - len(first)))
            top, mark, _ = first.partition(b"\r\n\r\n")
            if not mark or not top.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            used = len(top) + 4 + int(headers(top)["content-length"]) + 4
        yield at, used
        at += used


def places(archives: DataFrame) -> DataFrame:
    """Where each record of the archives stands: ``(path, start, bytes)``, counted from the archive's first byte.

    Read from the index of each archive (``indexes/*.cdxj``, offsets into its only ``archive/*.warc[.gz]``), a line at a time;
    archives without an index are walked. Members that are compressed as a whole can't be read in parts: such archives raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(path: str) -> Iterator[tuple[int, int]]:
            fs, at = files(path)
            with fs.open_input_file(at) as f:
                listed = directory(f, f.size())
                data = [m for m in listed if m[0].startswith("archive/") and m[0].endswith((".warc", ".warc.gz"))]
                index = [m for m in listed if m[0].startswith("indexes/") and m[0].endswith(".cdxj")]
                for name, method, _, _ in data + index:
                    if method:
                        raise ValueError(f"{path}: {name} is not stored")
                if len(data) == 1 and len(index) == 1:
                    left, rest = index[0][3], b""
                    f.seek(index[0][2])
                    while left or rest:
                        chunk = f.read(min(READ_BYTES, left))
                        left -= len(chunk)
                        *lines, rest = (rest + chunk).split(b"\n") if left else [*(rest + chunk).split(b"\n"), b""]
                        for line in filter(None, lines):
                            entry = json.loads(line)
                            yield data[0][2] + entry["offset"], entry["length"]
                else:
                    for _, _, start, size in data:
                        yield from walked(f, start, size)

        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple[int, int]] = []
                for place in found(path):
                    rows.append(place)
                    if len(rows) == 10_000:
                        yield batch_of(path, rows)
                        rows = []
                yield batch_of(path, rows)

    def batch_of(path: str, rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "start": s, "bytes": n} for s, n in rows], schema=PLACES_OUT)

    return archives.select("path").mapInArrow(run, PLACES)


def read_records(at: DataFrame) -> DataFrame:
    """The records at ``at(path, start, bytes)``, any subset of ``places`` in any order; nothing else of an archive is read.

    Records that follow each other are fetched together, up to 4 MB at once; a longer record alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, opened = None, None
        for b in batches:
            wanted = sorted(zip(*(b.column(c).to_pylist() for c in ("path", "start", "bytes")), strict=True))
            i = 0
            while i < len(wanted):
                path, start, size = wanted[i]
                j = i + 1
                while j < len(wanted) and wanted[j][:2] == (path, start + size) and size + wanted[j][2] <= READ_BYTES:
                    size += wanted[j][2]
                    j += 1
                if path != opened:
                    if f:
                        f.close()
                    fs, name = files(path)
                    f, opened = fs.open_input_file(name), path
                f.seek(start)
                raw = f.read(size)
                if len(raw) < size:
                    raise ValueError(f"{path} is cut short")
                rows = [parsed(raw[s - start : s - start + n]) | {"path": path, "start": s, "bytes": n} for _, s, n in wanted[i:j]]
                yield pa.RecordBatch.from_pylist(rows, schema=RECORDS_OUT)
                i = j
        if f:
            f.close()

    return at.select("path", "start", "bytes").mapInArrow(run, RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP archives, read back by range: see ``write_archives`` for odd rows.

    The archives and their list are deleted once the result, one short row a page, is written.
    """
    home = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        with scratch(spark):
            archives = write_archives(table(spark, sf_dir, "pages"), home)
            read = read_records(places(archives))
            return stored(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-read", keep=True)
    finally:
        deleted(spark, home)


#: DuckDB form: what the records say.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
w AS (SELECT page_id, b, octet_length(b) AS n, max(page_id) OVER (PARTITION BY b) AS last FROM p),
r AS (SELECT *, coalesce(n >= {REVISIT_BYTES} AND last IS NOT NULL AND page_id IS DISTINCT FROM last, false) AS revisit FROM w)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN last END AS refers_to FROM r"""
