"""Benchmark decontamination: all windows of benchmark words are searched for in texts by Wu and Manber's method.

The symbols are words.  A table of shifts tells for the block of words that ends
at a position how far the search may move on, as no searched window can end
before; where the shift is 0, the block's bucket of windows is looked up,
narrowed by a hash of the words before the block, and the bytes of all words are
compared.  The searches of a batch, one in each run of some hundred positions,
move on together.

The windows are loaded in slabs of bounded size, each of which is searched for
in all texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .storage import forget, keyed, written

#: Words of a window; shorter items are one window.
WINDOW_WORDS = 10
#: Bytes of benchmark text in a slab, about; what one broadcast holds.
SLAB_BYTES = 16 << 20
#: Longer benchmark texts are cut in pieces that share all but one of a window's words.
PIECE_BYTES = 1 << 20
#: Bytes of texts that are searched together; a longer text is alone.
SLICE_BYTES = 4 << 20
#: Words of a block, and positions that one search goes through.
BLOCK, LANE = 2, 256
#: A shift table has so many entries for a block, within these powers of two.
TABLE_FOR_BLOCK, TABLE_BITS = 8, (12, 24)
#: Candidates that are looked at together, and bytes compared together.
STEP, COMPARED = 1 << 16, 8 << 20


class Words:
    """Lower-cased words of texts that lie one after the other."""

    def __init__(self, column: pa.Array):
        data, offsets = bw.buffers(column)
        self.hashes, self.begin, self.stop, self.first = bw.words(data, offsets, bw.nonletter_table(), bw.lower_table())
        self.data = bw.lower_table()[data]


def _folded(hashes: np.ndarray, ends: np.ndarray, length: int, skip: int = 0) -> np.ndarray:
    """Hash of the `length` words that end `skip` words before each position."""
    out = np.full(len(ends), np.uint64(length + 1), np.uint64)
    for j in range(length + skip - 1, skip - 1, -1):
        out = bw.mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[ends - j])
    return out


def same_words(a: Words, ends_a: np.ndarray, b: Words, ends_b: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` words that end at ends_a are byte by byte those that end at ends_b."""
    if not len(ends_a):
        return np.zeros(0, bool)
    back = np.arange(1 - length, 1)
    at_a, at_b = ends_a[:, None] + back, ends_b[:, None] + back
    size = a.stop[at_a] - a.begin[at_a]
    out = (size == b.stop[at_b] - b.begin[at_b]).all(1)
    left = np.flatnonzero(out)
    total = np.cumsum(size[left].sum(1))
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, "right")))
        some = left[at:to]
        n = size[some].ravel()
        place = np.cumsum(n) - n
        step = np.arange(n.sum())
        differs = a.data[np.repeat(a.begin[at_a[some]].ravel() - place, n) + step] != b.data[np.repeat(b.begin[at_b[some]].ravel() - place, n) + step]
        of = np.searchsorted(np.cumsum(size[some].sum(1)), np.flatnonzero(differs), "right")
        out[some[of]] = False
        at = to
    return out


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    place = np.cumsum(size) - size
    return np.repeat(start - place, size) + np.arange(size.sum())


class Windows:
    """The distinct windows of one length, each with its items: table of shifts, buckets in the order of their hashes."""

    def __init__(self, words: Words, ends: np.ndarray, items: np.ndarray, length: int):
        self.words, self.length, self.block = words, length, min(BLOCK, length)
        key = self.keys(words.hashes, ends)
        order = np.argsort(key, kind="stable")
        key, ends, items = key[order], ends[order], items[order]
        # equal windows are one; of equal hashes, windows that differ stay apart
        lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rep = lead[np.searchsorted(lead, np.arange(len(key)), "right") - 1]
        own = ~same_words(words, ends, words, ends[rep], length)
        own[lead] = True
        of = np.where(own, np.arange(len(key)), rep)
        number = np.cumsum(own) - 1
        self.key, self.ends = key[own], ends[own]
        pairs = np.unique(np.stack([number[of], items], 1), axis=0)
        self.items, self.first_item = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(own.sum() + 1))
        self.bits = int(np.clip(int(TABLE_FOR_BLOCK * len(self.ends)).bit_length(), *TABLE_BITS))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        for back in range(length - self.block, -1, -1):
            self.shift[self.places(words.hashes, self.ends - back)] = back  # the smallest comes last

    def places(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the blocks that end at positions are in the table of shifts."""
        return (_folded(hashes, ends, self.block) >> np.uint64(64 - self.bits)).astype(np.int32)

    def keys(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the last block, then of the words before it."""
        suffix = _folded(hashes, ends, self.block) & ~np.uint64(0xFFFFFFFF)
        return suffix | (_folded(hashes, ends, self.length - self.block, self.block) >> np.uint64(32)) if self.length > self.block else _folded(hashes, ends, self.block)

    def candidates(self, text: Words) -> np.ndarray:
        """Positions where the shift is 0, of all texts."""
        n = np.maximum(np.diff(text.first) - self.length + 1, 0)
        lanes = -(-n // LANE)
        begin = np.repeat(text.first[:-1] + self.length - 1, lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        end = np.minimum(begin + LANE, np.repeat(text.first[1:], lanes))
        found = []
        while len(begin):
            shift = self.shift[self.places(text.hashes, begin)]
            found.append(begin[shift == 0])
            begin = begin + np.maximum(shift, 1)
            more = begin < end
            begin, end = begin[more], end[more]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its last word) of all occurrences."""
        at = self.candidates(text)
        windows, places = [], []
        for i in range(0, len(at), STEP):
            some = at[i : i + STEP]
            key = self.keys(text.hashes, some)
            low = np.searchsorted(self.key, key, "left")
            n = np.searchsorted(self.key, key, "right") - low
            window, place = _runs(low, n), np.repeat(some, n)
            real = same_words(self.words, self.ends[window], text, place, self.length)
            windows.append(window[real])
            places.append(place[real])
        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(windows), np.concatenate(places)


class Slab:
    """All windows of some benchmark texts, by length."""

    def __init__(self, items: pa.Table):
        self.ids, item = np.unique(np.array(items.column("item").to_pylist(), object), return_inverse=True)
        words = Words(items.column("text"))
        n = np.diff(words.first)
        self.kinds = []
        for length in range(1, WINDOW_WORDS + 1):
            rows = np.flatnonzero(n == length if length < WINDOW_WORDS else n >= length)
            if len(rows):
                size = n[rows] - length + 1
                self.kinds.append(Windows(words, _runs(words.first[rows] + length - 1, size), np.repeat(item[rows], size), length))

    def search(self, column: pa.Array) -> list[pa.Array]:
        """n_words, spans (first and last word of runs of hit words), items of each text."""
        text = Words(column)
        rows = len(text.first) - 1
        change, pairs = np.zeros(len(text.hashes) + 1, np.int32), [np.zeros((0, 2), np.int64)]
        for kind in self.kinds:
            window, place = kind.search(text)
            np.add.at(change, place - kind.length + 1, 1)
            np.add.at(change, place + 1, -1)
            row = np.searchsorted(text.first, place, "right") - 1
            row, window = np.unique(np.stack([row, window], 1), axis=0).T if len(row) else (row, window)
            n = kind.first_item[window + 1] - kind.first_item[window]
            pairs.append(np.stack([np.repeat(row, n), kind.items[_runs(kind.first_item[window], n)]], 1))
        row, item = np.unique(np.concatenate(pairs), axis=0).T
        hit = np.cumsum(change[:-1]) > 0
        edge = np.zeros(len(hit) + 1, bool)
        edge[text.first] = True
        new = hit & (np.r_[True, ~hit[:-1]] | edge[:-1])
        last = hit & (np.r_[~hit[1:], True] | edge[1:])
        begin, end = np.flatnonzero(new), np.flatnonzero(last)
        of = np.searchsorted(text.first, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - text.first[of], pa.int64()), pa.array(end - text.first[of], pa.int64())], names=["first", "last"])
        listed = lambda which, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(rows + 1)), pa.int32()), values)
        return [pa.array(np.diff(text.first), pa.int64()), listed(of, spans), listed(row, pa.array(self.ids[item], pa.string()))]


_LOADED: dict[str, Slab] = {}


def _loaded(name: str, shared) -> Slab:
    """The slab of a broadcast table, built once by each Python worker."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Slab(shared.value)
    return _LOADED[name]


def _pieces(batches):
    """item, text: long texts as pieces that together hold all windows."""
    for b in batches:
        items, texts = [], []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = text.encode()
            if len(raw) <= PIECE_BYTES:
                items.append(item)
                texts.append(text)
                continue
            w, at, to = Words(pa.array([raw], pa.binary())), 0, 0
            while to < len(w.begin):
                to = min(len(w.begin), max(at + WINDOW_WORDS, int(np.searchsorted(w.stop, w.begin[at] + PIECE_BYTES, "right"))))
                items.append(item)
                texts.append(raw[w.begin[at] : w.stop[to - 1]].decode())
                at = to - WINDOW_WORDS + 1
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])


def _merged(batches):
    """Spans of several slabs that overlap or touch become one."""
    far = 1 << 40
    for b in batches:
        spans = b.column("spans")
        row = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        begin, end = (flat.field(i).to_numpy() + row * far for i in (0, 1))
        order = np.argsort(begin, kind="stable")
        begin, upto, row = begin[order], np.maximum.accumulate(end[order]), row[order]
        new = np.flatnonzero(np.r_[True, begin[1:] > upto[:-1] + 1]) if len(begin) else np.zeros(0, np.int64)
        last = upto[np.r_[new[1:] - 1, len(begin) - 1]] if len(new) else upto
        values = pa.StructArray.from_arrays([pa.array(begin[new] - row[new] * far), pa.array(last - row[new] * far)], names=["first", "last"])
        merged = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(b.num_rows + 1)), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([merged if n == "spans" else b.column(n) for n in b.schema.names], names=b.schema.names)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (first, last: runs of hit words, counted from 0), item_ids (sorted strings): one row per row of docs.

    Words are runs of ASCII letters and digits, A to Z lower-cased, and of
    non-ASCII characters.  Every ten consecutive words of an item are a window,
    and so are all words of a shorter one; a word is hit inside any occurrence.
    Rows that share an item_id are one item; a null one is the empty string.
    Null texts have no words; items without words occur nowhere.  Repeated rows
    and null ids are kept, other columns ignored; an empty table of texts gives
    an empty result, an empty benchmark hits nothing.  Benchmarks beyond
    slab_bytes are searched for in slabs, one pass over the texts each.  A text
    is held by one task, with some ten times its size in words and hashes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    pieces = written(items.mapInArrow(_pieces, "item string, text string"), "benchmark")
    slabs = max(1, -(-(pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slab_bytes))
    rows, key = (docs, None) if slabs == 1 else keyed(docs)
    number = F.lit(0).cast("long") if key is None else F.col(key)
    texts = rows.select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def searched(i: int) -> DataFrame:
        part = pieces if slabs == 1 else pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(slabs)) == i)
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(part.toArrow())

        def run(batches):
            slab = _loaded(name, shared)
            for b in batches:
                _, offsets = bw.buffers(b.column(2))
                at = 0
                while at < b.num_rows:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), *slab.search(b.column(2).slice(at, to - at))], names=["row", "doc_id", "n_words", "spans", "item_ids"])
                    at = to

        return texts.mapInArrow(run, "row long, doc_id long, n_words long, spans array<struct<first:long,last:long>>, item_ids array<string>")

    found = searched(0)
    if slabs > 1:
        parts = [written(searched(i), "slab") for i in range(slabs)]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        found = written(found.mapInArrow(_merged, found.schema), "contamination")
        forget(rows, *parts)
    forget(pieces)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", F.sort_array("item_ids").alias("item_ids"))
