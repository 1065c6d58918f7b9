"""Content-chosen suffixes: for every window of a text the start of its smallest gram, in runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lexarium.llm.fingerprint import Ranges, mix

#: Bytes, and words, of a gram whose hash chooses the suffixes.
GRAM, WORD_GRAM = 64, 8
#: Starts of windows handled at once; a longer text is cut so that every window lies in one piece.
PIECE = 1 << 20
LOW = np.uint64((1 << 24) - 1)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours, by block-wise running minima from both sides."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    blocks = -(-len(keys) // w)
    padded = np.full(blocks * w, ~np.uint64(0))
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text: what ASCII white space separates."""
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1])  # starts and ends of words by turns
    return edge[::2], edge[1::2]


def word_values(raw: bytes) -> np.ndarray:
    """A 64-bit value of each word of a text."""
    start, end = word_places(raw)
    return mix(Ranges(np.frombuffer(raw, np.uint8)).raw(start, end) + (end - start).astype(np.uint64))


def byte_units(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def pieces(texts: list[bytes] | list[np.ndarray], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, owner, start in data, start in its text) of bounded groups of texts or parts of texts."""
    held: list = []
    owner, base, size = [], [], 0

    def give():
        data = np.frombuffer(b"".join(held), np.uint8) if isinstance(held[0], bytes) else np.concatenate(held)
        at = np.cumsum([0, *map(len, held)])[:-1]
        return data, np.array(owner), at, np.array(base)

    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - window + 1), PIECE):
            part = t[k : k + PIECE + window - 1]
            if len(part) < window:
                continue
            if held and size + len(part) > PIECE:
                yield give()
                held, owner, base, size = [], [], [], 0
            held.append(part)
            owner.append(i)
            base.append(k)
            size += len(part)
    if held:
        yield give()


def window_runs(texts: list[bytes] | list[np.ndarray], window: int, gram_size: int = GRAM) -> Iterator[dict[str, np.ndarray]]:
    """Runs of consecutive windows of ``window`` bytes (or words, of texts as ``word_values``) that share their leader.

    A window's leader is its smallest gram (of equal ones the last), so equal windows have equal leaders at
    the same offset wherever they stand. Yields arrays by run: ``owner`` (text), ``first`` and ``last`` (starts of
    its windows in the text), ``at`` (the leader's start in the text), ``lead`` (the leader's hash) and
    ``cls`` (a hash of the bytes that all its windows span, of the leader and of its offset).
    """
    w = window - gram_size + 1
    for data, owner, at, base in pieces(texts, window):
        ranges = Ranges(data)
        gram = ranges.grams(gram_size)
        keys = (gram & ~LOW) | (LOW - np.arange(len(gram), dtype=np.uint64))
        low = sliding_min(keys, w)
        leader = (LOW - (low & LOW)).astype(np.int64)
        sizes = np.diff(np.concatenate([at, [len(data)]]))
        part = np.repeat(np.arange(len(at)), sizes)[: len(low)]
        ok = np.arange(len(low)) + window <= (at + sizes)[part]
        new = np.concatenate([[True], (leader[1:] != leader[:-1]) | (part[1:] != part[:-1]) | (ok[1:] != ok[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(low)]]) - 1
        keep = ok[first]
        first, last = first[keep], last[keep]
        lead, p = leader[first], part[first]
        h = gram[lead]
        span = ranges.raw(first, last + window)
        offset = ((lead - first).astype(np.uint64) << np.uint64(16)) | (last - first).astype(np.uint64)
        shift = base[p] - at[p]
        yield {
            "owner": owner[p],
            "first": first + shift,
            "last": last + shift,
            "at": lead + shift,
            "lead": h.view(np.int64),
            "cls": mix(span ^ mix(h + offset)).view(np.int64),
        }
