"""Vectorised word and n-gram hashing over the bytes of an Arrow string column.

All functions look at whole texts.  Work is done in windows of about one
megabyte that end at a row boundary or at a separator byte, so the scratch
arrays stay small however long a text is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def space_table() -> np.ndarray:
    """Separators are the bytes 0x20 and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def nonletter_table() -> np.ndarray:
    """Separators are the ASCII bytes that are neither letters nor digits; all bytes of multi-byte characters belong to words."""
    table = np.ones(256, bool)
    table[128:] = False
    for c in range(128):
        if chr(c).isalnum():
            table[c] = False
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


@functools.lru_cache(1)
def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
    """Cuts at row boundaries or separators, WINDOW bytes apart where the text allows it."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + WINDOW)
        while to < end:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row > at and row >= to - WINDOW // 2:
                to = row
                break
            gaps = np.flatnonzero(sep[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            nxt = int(offsets[np.searchsorted(offsets, to, "left")])
            to = min(end, nxt, to + WINDOW)
            if to == nxt:
                break
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, in order, and for each row the index of its first word (one more entry than rows)."""
    hashes, starts, ends = [], [], []
    codes = _byte_codes()[lower]
    for at, to in _windows(data, offsets, sep):
        piece = data[at:to]
        inside = ~sep[piece]
        first = np.empty(len(piece), bool)
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        edge = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "left")] - at
        first[edge] = True
        begin = np.flatnonzero(first & inside)
        if not len(begin):
            continue
        last = np.empty(len(piece), bool)
        last[-1] = True
        last[:-1] = ~inside[1:] | first[1:]
        stop = np.flatnonzero(last & inside)
        size = max(WINDOW, 1 << (len(piece) - 1).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes[piece] * up[: len(piece)], out=total[1:])
        hashes.append(mix64((total[stop + 1] - total[begin]) * down[begin]))
        starts.append(begin + at)
        ends.append(stop + 1 + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    place = np.concatenate(starts)
    return np.concatenate(hashes), place, np.concatenate(ends), np.searchsorted(place, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and for each row the index of its first word (one more entry than rows)."""
    hashes, _, _, first = words(data, offsets, sep, lower)
    return hashes, first


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; a shorter, non-empty sequence is one run of its own length."""
    if len(words) == 0:
        return words
    if len(words) < n:
        with np.errstate(over="ignore"):
            weights = _powers(WINDOW)[0][1 : len(words) + 1]
            return mix64(np.array([(words * weights).sum() + np.uint64(len(words))], np.uint64))
    weights = _powers(WINDOW)[0][7 : 7 + n]
    out = words[: len(words) - n + 1] * weights[0]
    for j in range(1, n):
        out += words[j : len(words) - n + 1 + j] * weights[j]
    return mix64(out)
