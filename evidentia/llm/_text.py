"""Vectorised work on the bytes of many texts at once.

Texts come as Arrow columns. A column's bytes stay in one buffer and are handled in blocks of about BLOCK bytes, so the memory of a
Python worker doesn't depend on the batch. A longer text is a block of its own, which is read in pieces of about BLOCK bytes that end
behind white space: what stays in memory of it is one number for each word. The tables of powers have BLOCK entries whatever the texts;
a word longer than that takes a factor from one block of its bytes to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
U = np.uint64
#: Base of the polynomial hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

IS_WS = np.zeros(256, bool)
IS_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """base^0 .. base^(BLOCK - 1) modulo 2^64."""
    if base not in _powers:
        seed = np.full(BLOCK, base, U)
        seed[0] = 1
        _powers[base] = np.multiply.accumulate(seed)
    return _powers[base]


def _times_powers(values: np.ndarray, places: np.ndarray | None, base: int) -> None:
    """values *= base^places (None: 0, 1, ...), in place; beyond the table by a factor for each block of places."""
    table = powers(base)
    if places is None:
        for k in range(0, len(values), BLOCK):
            part = values[k : k + BLOCK]
            part *= table[: len(part)]
            if k:
                part *= U(pow(base, k, 1 << 64))
    elif not len(places) or places[-1] < BLOCK:
        values *= table[places]
    else:
        factors = np.array([pow(base, k, 1 << 64) for k in range(0, int(places[-1]) + 1, BLOCK)], U)
        values *= table[places % BLOCK]
        values *= factors[places // BLOCK]


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    z ^= z >> U(30)
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its n values (n + 1 of them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets from 0) of runs of texts with at most limit bytes, or of one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n, i + 4096)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte * BASE^place before each place; the hash of data[i:j] is (out[j] - out[i]) / BASE^i."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    terms = data.astype(U)
    terms += U(1)
    _times_powers(terms, None, BASE)
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, whose starts ascend."""
    out = prefix[ends]
    out -= prefix[starts]
    _times_powers(out, starts, INVERSE)
    out ^= (ends - starts).astype(U)
    return mix(out)


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end behind white space or with the text; a longer word isn't cut."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            gaps = np.flatnonzero(IS_WS[data[a:b]])
            while not len(gaps) and b < n:
                a_, b = b, min(n, b + BLOCK)
                gaps = np.flatnonzero(IS_WS[data[a_:b]]) + (a_ - a)
            b = a + int(gaps[-1]) + 1 if len(gaps) else n
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, change: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, whose bytes go through the table `change` first, and the place of each text's first word (n + 1 places)."""
    if len(data) <= BLOCK or len(offsets) > 2:
        data = data if change is None else change[data]
        starts, ends, first = word_spans(data, offsets)
        return span_hash(prefix_hash(data), starts, ends), first
    parts = [word_hashes(data[a:b], np.array([0, b - a]), change)[0] if b - a <= BLOCK else _long(data[a:b], change) for a, b in pieces(data)]
    return np.concatenate(parts), np.array([0, sum(map(len, parts))])


def _long(data: np.ndarray, change: np.ndarray | None) -> np.ndarray:
    """Hashes of the words of a piece with a word longer than BLOCK bytes."""
    data = data if change is None else change[data]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return span_hash(prefix_hash(data), starts, ends)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs outside the contracts' white space), and for each text the place of its first word (n + 1 places)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    ws = IS_WS[data]
    before, after = np.empty_like(ws), np.empty_like(ws)
    before[0] = after[-1] = True
    before[1:], after[:-1] = ws[:-1], ws[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    np.logical_not(ws, out=ws)
    before &= ws
    after &= ws
    starts, ends = np.flatnonzero(before), np.flatnonzero(after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space replaced by one space."""
    if not len(data):
        return data, offsets
    ws = IS_WS[data]
    keep = np.empty_like(ws)
    keep[0] = True
    np.logical_and(ws[1:], ws[:-1], out=keep[1:])
    np.logical_not(keep[1:], out=keep[1:])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    out = np.where(ws, np.uint8(32), data)[keep]
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return out, ends[offsets]
