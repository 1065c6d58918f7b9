"""Media columns: texts as 8-bit WAV files, their short-time spectra and peak-pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import slices, table

RATE = 8000
BLOCK = 64
FRAME, HOP = 256, 128
#: Frequency bands (in bins of the transform, without the constant one), one peak candidate a frame each.
BANDS = ((1, 17), (17, 49), (49, 129))
#: A peak is paired with so many of the next peaks, at most so many frames later.
FAN_OUT, MAX_DT = 2, 63
#: Frames transformed at once.
FRAMES = 8192

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("media", pa.binary()),
        ("payload", pa.binary()),
        ("fingerprint", pa.list_(pa.int64())),
    ]
)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprints(payloads: list[bytes]) -> list:
    """Peak-pair codes of each payload: frame << 32 | first bin << 16 | second bin << 8 | frames between.

    A peak is the strongest bin of a band in a frame, above twice the frame's mean and not below the
    band's strongest in the two frames around. Silence has none.
    """
    import numpy as np

    buffers, counts = [], []
    for p in payloads:
        n = max(1, -(-max(len(p) - FRAME, 0) // HOP) + 1)
        buffers.append(p + bytes(FRAME + (n - 1) * HOP - len(p)))
        counts.append(n)
    best = np.empty((sum(counts), len(BANDS)), np.int16)
    power = np.empty((sum(counts), len(BANDS)), np.float32)
    window = np.hanning(FRAME).astype(np.float32)

    def transform(rows: list, at: int) -> None:
        x = np.concatenate(rows) if len(rows) > 1 else rows[0]
        spectrum = np.abs(np.fft.rfft((x.astype(np.float32) - 128) * window, axis=1)).astype(np.float32)
        floor = 2 * spectrum[:, 1:].mean(axis=1) + 1e-3
        for k, (lo, hi) in enumerate(BANDS):
            top = spectrum[:, lo:hi].argmax(axis=1)
            p = spectrum[np.arange(len(x)), lo + top]
            best[at : at + len(x), k] = lo + top
            power[at : at + len(x), k] = np.where(p > floor, p, 0)

    rows, held, at = [], 0, 0
    for buf, n in zip(buffers, counts, strict=True):
        frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buf, np.uint8), FRAME)[::HOP]
        for i in range(0, n, FRAMES):
            rows.append(frames[i : i + FRAMES])
            held += len(rows[-1])
            if held >= FRAMES:
                transform(rows, at)
                rows, at, held = [], at + held, 0
    if rows:
        transform(rows, at)

    owner = np.repeat(np.arange(len(payloads)), counts)
    first_frame = np.cumsum(counts) - counts
    time = np.arange(len(owner)) - first_frame[owner]
    same_prev = np.concatenate([[False], owner[1:] == owner[:-1]])
    same_next = np.concatenate([same_prev[1:], [False]])
    rounded = np.round(power, 1)
    before = np.where(same_prev[:, None], np.roll(rounded, 1, axis=0), 0)
    after = np.where(same_next[:, None], np.roll(rounded, -1, axis=0), 0)
    f, k = np.nonzero((rounded > 0) & (rounded >= before) & (rounded >= after))
    t, o, b = time[f].astype(np.int64), owner[f], best[f, k].astype(np.int64)
    codes, of = [], []
    for step in range(1, FAN_OUT + 1):
        dt = t[step:] - t[:-step]
        ok = (o[step:] == o[:-step]) & (dt <= MAX_DT)
        codes.append(((t[:-step] << 32) | (b[:-step] << 16) | (b[step:] << 8) | dt)[ok])
        of.append(o[:-step][ok])
    codes, of = np.concatenate(codes), np.concatenate(of)
    order = np.lexsort((codes, of))
    return np.split(codes[order], np.cumsum(np.bincount(of, minlength=len(payloads)))[:-1])


def encode_media(docs: DataFrame) -> DataFrame:
    """Every text as a WAV file, read back, with its fingerprint.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. The payload is the text's UTF-8 with
    zero bytes appended up to a positive multiple of 64, one 8-bit sample a byte at 8 kHz. Returns
    ``doc_id, n_bytes, media binary, payload binary (read back by the wave module), fingerprint
    array<bigint>`` (time-coded, ascending). A null text counts as empty: 64 zero samples. Equal texts give
    equal values; repeated rows are kept; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in slices(texts):
                raw = [(t or "").encode() for t in texts[i:j]]
                media = [to_wav(r + bytes(-len(r) % BLOCK or (0 if r else BLOCK))) for r in raw]
                payload = [from_wav(m) for m in media]
                marks = fingerprints(payload)
                ends = np.concatenate([[0], np.cumsum([len(m) for m in marks])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j], pa.int64()),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array(media, pa.binary()),
                        pa.array(payload, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(marks), pa.int64())),
                    ],
                    schema=SCHEMA,
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, media binary, payload binary, fingerprint array<bigint>"
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's samples; a null or empty text is 64 zero samples without a peak; equal texts have equal values.

    Repeated rows and null ids are kept; other columns are not read; an empty table gives no rows.
    """
    m = encode_media(table(spark, sf_dir, "documents"))
    size = F.length("payload")
    return m.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.col("payload").substr(size - BLOCK + 1, F.lit(BLOCK))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint").cast("string"), F.lower(F.lpad(F.hex(F.xxhash64("fingerprint")), 16, "0"))).alias("feature"),
    )


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5_media`` that tell the samples read back."""
    return op5_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


#: DuckDB form of ``media_payloads``: a WAV file has 44 bytes before its samples.
PAYLOADS = r"""WITH r AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, greatest(64, ((octet_length(b) + 63) // 64) * 64) AS size, b FROM r)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(b || repeat('\x00'::BLOB, size - n)) AS payload_sha256, size + 44 AS media_bytes FROM p"""
