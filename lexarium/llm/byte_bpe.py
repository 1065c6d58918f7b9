"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import slices, table

#: Distinct words whose ids a worker keeps; the memo is emptied when full, so it only bounds memory.
MEMO_WORDS = 400_000

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("token_ids", pa.list_(pa.int32())),
        ("char_starts", pa.list_(pa.int32())),
        ("decoded", pa.binary()),
    ]
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def last_split(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the rank rule joins to ``token`` at last, or None if it does not reach the token.

    The rule: of all neighbours that make a token together, those of the lowest rank are joined, the leftmost first.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    none = len(ranks)
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
        if rank == none:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBPE:
    """A byte-level BPE built from the text of a rank file.

    The library takes merges, in order, and the rank file has none: each token gets the one that the rank rule ends
    with on the token alone (``last_split``). Wherever the rule makes a token of some bytes of a word, nothing has
    joined these bytes with others before, so it went the same way as on the token alone: with one merge a
    token, ranked as the token is, the library gives the rule's ids. A token that the rule never reaches
    has none and stands only for the whole word that it is (``ignore_merges``).
    """

    def __init__(self, ranks_file: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.np = np
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x.strip())}
        in_order = sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
        splits = [x for x in (last_split(t, ranks) for t in in_order) if x]
        model = models.BPE(
            vocab={self.to_chars(t): r for t, r in ranks.items()},
            merges=[(self.to_chars(a), self.to_chars(b)) for a, b in splits],
            ignore_merges=True,
        )
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for chars, i in self.tokenizer.get_vocab().items():
            by_id[i] = bytes(self.byte_of[c] for c in chars)
        self.bytes_of = pa.array(by_id, pa.large_binary())
        self.memo: dict[str, bytes] = {}

    def to_chars(self, token: bytes) -> str:
        return "".join(self.alphabet[b] for b in token)

    def learn(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.memo[word] = self.np.array(e.ids, self.np.int32).tobytes()

    def encode(self, texts: list[str]):
        """Flat int32 ids of all texts and each text's end among them."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        words = [self.find(t) for t in texts]
        new = list({w for own in words for w in own if w not in self.memo})
        if new:
            self.learn(new)
        get = self.memo.__getitem__
        parts = [b"".join(map(get, own)) for own in words]
        ends = self.np.cumsum([len(p) // 4 for p in parts], dtype=self.np.int64)
        return self.np.frombuffer(b"".join(parts), self.np.int32), ends

    def decode(self, ids, ends) -> pa.Array:
        """The bytes of each text; characters split between tokens come together again as bytes."""
        taken = self.bytes_of.take(pa.array(ids, pa.int64()))
        offsets = self.np.frombuffer(taken.buffers()[1], self.np.int64)[: len(ids) + 1]
        cuts = offsets[self.np.concatenate([[0], ends])].astype(self.np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.tobytes()), taken.buffers()[2]])

    def char_starts(self, ids, ends, raw: pa.Array):
        """For each token the index, in its text, of the character that its first byte belongs to."""
        np = self.np
        lengths = np.diff(np.frombuffer(self.bytes_of.buffers()[1], np.int64))[ids]
        at = np.cumsum(lengths) - lengths
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1  # index of the character that each byte is in
        starts = char_of[at] if len(ids) else at
        before = np.concatenate([[0], ends])[:-1]
        sizes = np.diff(np.concatenate([[0], ends]))
        first = np.zeros(len(ends), np.int64)
        some = sizes > 0
        first[some] = starts[before[some]]
        return (starts - np.repeat(first, sizes)).astype(np.int32)


_built: dict[tuple, ByteBPE] = {}


def worker_bpe(ranks_file: bytes, pattern: str) -> ByteBPE:
    key = (hashlib.sha256(ranks_file).digest(), pattern)
    if key not in _built:
        _built[key] = ByteBPE(ranks_file, pattern)
    return _built[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Token ids of every text and the bytes that they decode to.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id, token_ids
    array<int>, char_starts array<int>, decoded binary``; ``char_starts`` (null unless ``offsets``) holds
    the character in which each token begins, so tokens within one character share a start. A null or
    empty text has no tokens. Repeated rows are kept; an empty table gives no rows. The rank file
    (bounded: its size does not depend on the corpus) is read once on the driver.
    """
    with open(ranks_path, "rb") as f:
        ranks_file = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = worker_bpe(ranks_file, pattern)
        for b in batches:
            ids_in, texts = b.column("doc_id"), b.column("text").to_pylist()
            for i, j in slices(texts):
                ids, ends = bpe.encode([t or "" for t in texts[i:j]])
                cuts = pa.array(np.concatenate([[0], ends]), pa.int32())
                decoded = bpe.decode(ids, ends)
                starts = (
                    pa.ListArray.from_arrays(cuts, pa.array(bpe.char_starts(ids, ends, decoded)))
                    if offsets
                    else pa.nulls(j - i, SCHEMA.field("char_starts").type)
                )
                yield pa.RecordBatch.from_arrays(
                    [ids_in.slice(i, j - i), pa.ListArray.from_arrays(cuts, pa.array(ids)), starts, decoded], schema=SCHEMA
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, token_ids array<int>, char_starts array<int>, decoded binary"
    )


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("char_starts").alias("starts_xxhash64"),
        *more,
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids, decoded bytes and token starts; a null or empty text has no tokens.

    Repeated rows and null ids are kept; other columns are not read; an empty table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, offsets=True))
