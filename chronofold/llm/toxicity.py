"""Toxicity by class-conditional Kneser-Ney models.

Two models of word pairs, one of toxic and one of ordinary texts, are counted
over all labelled training texts, each pair (word before, word) once a text.
Each model interpolates discounted pair counts with its continuation counts (how
many words a word follows), and these with continuation counts of both kinds of
texts together.  A text's score compares its log-likelihoods, over all of its
words, divided by their number; a logistic curve fitted on a bounded sample of
training texts, each scored with its own counts taken off, turns that into a
probability.

Texts are kept as chunks of words, bucketed by chunk.  Chunks send the hashes of
their distinct words, 64 bits at every size, to buckets of the hash range, which
number the words of training texts; all other words are one, as no count tells
them apart.  A pair is then two numbers beside one another, spread over its
range by a one-to-one mapping, so pairs never collide.  Every chunk sends its
distinct pairs in order, with the counts of its own training texts, to buckets
of that range; a bucket adds the counts of all chunks and answers each one in
the order of its pairs.  Of the chunks that hold a pair one owns it and counts
it in the words' continuation counts, which are added and answered in the same
way.  So counts are tables that grow with the corpus.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .bpe_table import _pack, _unpack
from .language_mixture import held_out
from .storage import delete_path, forget, new_path, written

#: Labelled texts that the curve is fitted on, about and at most.
CALIBRATION_ROWS = 20_000
#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Bytes of text for which there is a bucket of pairs, and one of words.
PAIR_BUCKET_BYTES = 40 << 20
WORD_BUCKET_BYTES = 160 << 20
#: Means over a text's words of the log-ratio and of what is above 1, 2 and 3, and of the continuation models' log-ratio and what is above 1 and 2.
FEATURES = ("ratio", "peak1", "peak2", "peak3", "lower", "lower1", "lower2")
#: What is counted of a word: as the word before, its pairs and kinds of pairs in ordinary and toxic texts; as a word, the kinds of words before it in ordinary, toxic and all texts.
_UNIT = ("total0", "total1", "kinds0", "kinds1", "before0", "before1", "before")


#: Numbers of a text's beginning and of every word that no training text holds; then those of words.
_BEGIN, _UNSEEN, _FIRST = 0, 1, 2


def _chunks(column: pa.Array):
    """(first row, rows, vocabulary, words as indices into it, the rows' numbers of words) of runs of rows."""
    data, offsets = bw.buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        hashes, first = bw.word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], bw.nonletter_table(), bw.lower_table())
        vocabulary, words, times = np.unique(hashes, return_inverse=True, return_counts=True)
        # frequent words get small indices, which compress better; of about the same frequency they stay in the order of their hashes
        order = np.argsort(-np.log2(times).astype(np.int64), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield at, to - at, vocabulary[order], rank[words], np.diff(first)
        at = to


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one mapping of numbers of so many bits that spreads them over their range."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for m in _MULTIPLIERS:
        x = (x * np.uint64(m)) & mask
        x = x ^ (x >> half)
    return x


def unscramble(x: np.ndarray, bits: int) -> np.ndarray:
    """What scramble was given."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for m in reversed(_MULTIPLIERS):
        x = x ^ (x >> half)
        x = (x * np.uint64(pow(m, -1, 1 << bits))) & mask
    return x


class Pairs:
    """Distinct pairs of a chunk in the order of their keys, and each text's pairs with how often it holds them.

    numbers: of the chunk's vocabulary; words: indices into it; width: bits of a number.
    """

    def __init__(self, numbers: np.ndarray, words: np.ndarray, sizes: np.ndarray, width: int):
        self.width = width
        after = numbers.astype(np.uint64)[words]
        row, before = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(words), np.uint64)
        before[1:] = after[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = _BEGIN
        keys, place = np.unique(scramble(before << np.uint64(width) | after, 2 * width), return_inverse=True)
        pairs = unscramble(keys, 2 * width)
        before, after = pairs >> np.uint64(width), pairs & np.uint64((1 << width) - 1)
        self.known = (before != _UNSEEN) & (after != _UNSEEN)  # no other pair was ever counted
        self.keys = keys[self.known]
        self.units = np.unique(np.r_[np.uint64(_BEGIN), before, after])
        self.before, self.word = np.searchsorted(self.units, before), np.searchsorted(self.units, after)
        cells, self.times = np.unique(row * max(len(keys), 1) + place, return_counts=True)
        self.first = np.searchsorted(cells, np.arange(len(sizes) + 1) * max(len(keys), 1))
        self.cells = cells % max(len(keys), 1)

    def unit_keys(self) -> np.ndarray:
        return scramble(self.units, self.width)

    def counts(self, kind: np.ndarray) -> np.ndarray:
        """[2, known pairs]: in how many ordinary (kind 0) and toxic (1) texts each pair occurs; other kinds count nothing."""
        mine = np.repeat(kind, np.diff(self.first))
        return np.stack([np.bincount(self.cells[mine == c], minlength=len(self.word)) for c in (0, 1)])[:, self.known]

    def all_pairs(self, found: np.ndarray) -> np.ndarray:
        """Rows of counts of the known pairs as rows of counts of all."""
        out = np.zeros((len(found), len(self.word)), np.int64)
        out[:, self.known] = found
        return out

    def unit_counts(self, n: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """[units, _UNIT]: what the owned pairs add to their words, from the pairs' counts n over all texts."""
        out = np.zeros((len(self.units), len(_UNIT)), np.int64)
        for c in (0, 1):
            here = owned & (n[c] > 0)
            out[:, c] = np.bincount(self.before[here], n[c][here], len(out))
            out[:, 2 + c] = np.bincount(self.before[here], minlength=len(out))
            out[:, 4 + c] = np.bincount(self.word[here], minlength=len(out))
        out[:, 6] = np.bincount(self.word[owned & (n.sum(0) > 0)], minlength=len(out))
        return out


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit numbers, all lowest ones first: small numbers then compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


#: Bits of a count in the byte that it shares with its neighbours: ordinary and toxic counts of a key, and whether a message owns it.
_KEY_BITS = (4, 3, 1)


def pack_counts(values: np.ndarray, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Counts [rows, keys] in bytes: each row has so many bits of a byte with the rows beside it, and what doesn't fit follows in planes.

    Rows that share a byte are compressed as one symbol.
    """
    out, more, room = [], [], 0
    for v, b in zip(values, bits, strict=True):
        top = (1 << b) - 1
        if b == 1:  # a flag has no more to say
            low = v.astype(np.uint8)
        else:
            low = np.minimum(v, top).astype(np.uint8)
            more.append(_planes(v[v >= top] - top))
        if room < b:
            out.append(np.zeros(values.shape[1], np.uint8))
            room = 8
        room -= b
        out[-1] |= low << np.uint8(room)
    return out + more


def unpack_counts(parts: list[bytes], bits: tuple[int, ...]) -> np.ndarray:
    """What pack_counts packed."""
    used, room, places = -1, 0, []
    for b in bits:
        if room < b:
            used, room = used + 1, 8
        room -= b
        places.append((used, room))
    more, out = iter(parts[used + 1 :]), []
    for (at, shift), b in zip(places, bits, strict=True):
        top = (1 << b) - 1
        v = ((np.frombuffer(parts[at], np.uint8) >> np.uint8(shift)) & np.uint8(top)).astype(np.int64)
        if b > 1:
            v[v == top] += _from_planes(next(more)).astype(np.int64)
        out.append(v)
    return np.stack(out)


def _bits_of(rows: int) -> tuple[int, ...]:
    """The bits of a message's or an answer's rows: two kinds of counts and a flag share a byte, other counts have one each."""
    return _KEY_BITS[:rows] if rows <= len(_KEY_BITS) else (8,) * rows


def pack_message(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys, as differences, and rows of small counts beside them [counts, keys]."""
    return _pack(_planes(np.diff(keys, prepend=np.uint64(0))), np.array([len(values)], np.uint8), *pack_counts(values, _bits_of(len(values))))


def unpack_message(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, rows, *counts = _unpack(packed)
    return np.cumsum(_from_planes(keys), dtype=np.uint64), unpack_counts(counts, _bits_of(rows[0]))


def _bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets of equal parts of the hash range."""
    high = keys >> np.uint64(bits - 31) if bits > 31 else keys << np.uint64(31 - bits)
    return ((high * np.uint64(buckets)) >> np.uint64(31)).astype(np.int64)


def messages(chunk: int, keys: np.ndarray, values: np.ndarray, bits: int, buckets: int):
    """Record batches chunk, bucket, packed: keys (in any order, repeats allowed) and their counts [counts, keys], summed over equal keys."""
    distinct, summed = keys, np.asarray(values, np.int64)
    if (keys[1:] <= keys[:-1]).any():
        distinct, place = np.unique(keys, return_inverse=True)
        summed = np.stack([np.bincount(place, v, len(distinct)).astype(np.int64) for v in values])
    bucket = _bucket_of(distinct, bits, buckets)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    packed = [pack_message(distinct[a:b], summed[:, a:b]) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)]
    return pa.table({"chunk": pa.array(np.full(len(cut), chunk)), "bucket": pa.array(bucket[cut]), "packed": pa.array(packed, pa.binary())})


def totals(packed: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of messages of one bucket: each one's places among the distinct keys, the message that first has a key, and the sums [counts, keys]."""
    found = [unpack_message(x) for x in packed]
    keys, first, place = np.unique(np.concatenate([k for k, _ in found]), return_index=True, return_inverse=True)
    ends = np.cumsum([len(k) for k, _ in found])
    values = np.concatenate([v for _, v in found], 1)
    summed = np.stack([np.bincount(place, v, len(keys)).astype(np.int64) for v in values])
    return np.split(place, ends[:-1]), first, np.r_[0, ends[:-1]], summed


def answers(key, table):
    """chunk, bucket, packed: the sums of all chunks for every message's keys, in their order, and whether the message owns the key."""
    table = table.sort_by("chunk")
    places, first, start, summed = totals(table.column("packed").to_pylist())
    out = []
    for at, place in zip(start, places, strict=True):
        own = (first[place] == at + np.arange(len(place))) & summed[:, place].any(0)  # nobody needs to own what was never counted
        out.append(_pack(np.array([len(summed) + 1], np.uint8), *pack_counts(np.concatenate([summed[:, place], own[None].astype(np.int64)]), _bits_of(len(summed) + 1))))
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "packed": pa.array(out, pa.binary())})


def ranks(key, table):
    """chunk, bucket, packed: of every message's words, in their order, which ones training texts hold, and their ranks among the bucket's words that do."""
    table = table.sort_by("chunk")
    places, _, _, summed = totals(table.column("packed").to_pylist())
    seen = summed[0] > 0
    rank = np.cumsum(seen)
    packed = [_pack(_planes(np.diff(rank[x], prepend=0)), np.packbits(seen[x])) for x in places]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "packed": pa.array(packed, pa.binary())})


def numbers(replies: pa.Table, buckets: int) -> np.ndarray:
    """Numbers of a chunk's words, in the order of their hashes: each bucket's ranks are numbers of their own."""
    out = [np.zeros(0, np.int64)]
    for bucket, packed in zip(*(replies.sort_by("bucket").column(c).to_pylist() for c in ("bucket", "packed")), strict=True):
        step, seen = _unpack(packed)
        rank = np.cumsum(_from_planes(step).astype(np.int64))
        out.append(np.where(np.unpackbits(np.frombuffer(seen, np.uint8), count=len(rank)) > 0, _FIRST + (rank - 1) * buckets + bucket, _UNSEEN))
    return np.concatenate(out)


def gathered(replies: pa.Table, keys: np.ndarray) -> np.ndarray:
    """[counts + 1, keys]: what came back for a chunk's keys, in their order; the last row tells which of them it owns (the first of equal ones)."""
    parts = []
    for packed in replies.sort_by("bucket").column("packed").to_pylist():
        rows, *counts = _unpack(packed)
        parts.append(unpack_counts(counts, _bits_of(rows[0])))
    flat = np.concatenate(parts, 1) if parts else np.zeros((1, 0), np.int64)
    if not (keys[1:] <= keys[:-1]).any() and flat.shape[1] == len(keys):
        return flat
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    if flat.shape[1] != len(distinct):
        raise RuntimeError("a chunk's keys and the answers differ in number")
    out = flat[:, place]
    out[-1] &= first[place] == np.arange(len(keys))
    return out


def discounts(seen: np.ndarray) -> np.ndarray:
    """Kneser-Ney discount of each kind of texts from the numbers of pairs that occur in one and in two of them [kinds, 2]."""
    return np.where(seen[:, 0] > 0, np.clip(seen[:, 0] / np.maximum(seen[:, 0] + 2 * seen[:, 1], 1), 0.1, 0.95), 0.5)


def log_ratios(n: np.ndarray, before: np.ndarray, word: np.ndarray, totals: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """log P(word | word before, toxic) - log P(word | word before, ordinary) of pairs.

    n: [2, pairs] counts; before: [4, pairs], word: [3, pairs], the first four
    and last three of _UNIT for the pair's words; totals: of all words the kinds
    of pairs in ordinary, toxic and all texts, and the words with such pairs;
    discount: of ordinary and toxic texts.
    """
    shared = (word[2] + 0.5) / (totals[2] + 0.5 * (totals[5] + 1))  # one more for all words never seen
    out = []
    for c in (0, 1):
        every, d = max(float(totals[c]), 1.0), discount[c]
        lower = np.maximum(word[c] - d, 0) / every + (d * totals[3 + c] / every if totals[c] > 0 else 1.0) * shared
        total = np.maximum(before[c], 1)
        out.append(np.log(np.where(before[c] > 0, np.maximum(n[c] - d, 0) / total + d * before[2 + c] / total * lower, lower)))
    return out[1] - out[0]


def without_own(kind: int, n: np.ndarray, before: np.ndarray, word: np.ndarray, totals: np.ndarray, left: np.ndarray, right: np.ndarray):
    """The arguments of log_ratios for the pairs of one text of a kind (1 is toxic), as if it hadn't been counted; left and right number the pairs' words."""
    n, before, word, totals = n.copy(), before.copy(), word.copy(), totals.copy()
    last, only = n[kind] == 1, n.sum(0) == 1
    n[kind] -= 1
    _, left = np.unique(left, return_inverse=True)
    at, right = np.unique(right, return_index=True, return_inverse=True)[1:]
    before[kind] -= np.bincount(left)[left]
    before[2 + kind] -= np.bincount(left, last)[left].astype(np.int64)
    for i, gone in ((kind, last), (2, only)):
        had = word[i][at] > 0
        word[i] -= np.bincount(right, gone)[right].astype(np.int64)
        totals[i] -= gone.sum()
        totals[3 + i] -= (had & (word[i][at] == 0)).sum()
    return n, before, word, totals


def summaries(n: np.ndarray, before: np.ndarray, word: np.ndarray, totals: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """[features, pairs]: what FEATURES are means of, from the arguments of log_ratios."""
    out = np.empty((len(FEATURES), n.shape[1]))
    for at in range(0, n.shape[1], 1 << 18):
        cut = np.s_[:, at : at + (1 << 18)]
        value = log_ratios(n[cut], before[cut], word[cut], totals, discount)
        lower = log_ratios(np.zeros_like(n[cut]), np.zeros_like(before[cut]), word[cut], totals, discount)
        out[cut] = [value, *[np.maximum(value - x, 0) for x in (1, 2, 3)], lower, *[np.maximum(lower - x, 0) for x in (1, 2)]]
    return out


class _Tables:
    """Tables in the shared folder, bucketed by chunk, so that grouping by it doesn't shuffle them; dropped with their files at the end."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.made = spark, buckets, []

    def write(self, df: DataFrame) -> DataFrame:
        name, path = f"chronofold_{uuid.uuid4().hex}", new_path(self.spark, "bucketed")
        self.made.append((name, path))
        df.write.bucketBy(self.buckets, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def __enter__(self) -> _Tables:
        return self

    def __exit__(self, *_) -> None:
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)


def text_features(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, FEATURES and loglen of every row (doc_id, text), and own, the same without its own counts, for the sampled ones.

    marks: doc_id, kind (0 ordinary, 1 toxic), sampled; one row an id.  Rows with
    these ids are the training texts.  Second result: the discounts.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _Tables(spark, max(parts, size // CHUNK_BYTES)) as tables:
        return _features(rows, marks, tables, max(parts, size // PAIR_BUCKET_BYTES), max(parts, size // WORD_BUCKET_BYTES))


def _features(rows: DataFrame, marks: DataFrame, tables: _Tables, pair_buckets: int, word_buckets: int) -> tuple[DataFrame, np.ndarray]:
    def code(batches):
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            for first, n, vocabulary, words, sizes in _chunks(b.column(1)):
                ids = pa.array([b.column(0).slice(first, n).to_pylist()], pa.list_(pa.int64()))
                packed = [pa.array([_pack(*map(_planes, x))], pa.binary()) for x in ((np.diff(vocabulary, prepend=np.uint64(0)),), (words, sizes))]
                yield pa.RecordBatch.from_arrays([pa.array([at]), ids, *packed], names=["chunk", "ids", "vocabulary", "packed"])
                at += 1

    spelt = tables.write(rows.select("doc_id", "text").mapInArrow(code, "chunk long, ids array<long>, vocabulary binary, packed binary"))
    listed = spelt.select("chunk", F.posexplode("ids").alias("pos", "doc_id")).where("doc_id is not null")
    # always by merging, so that the plan is the same at every size
    kinds = written(listed.hint("merge").join(marks.hint("merge"), "doc_id").select("chunk", "pos", F.col("kind").cast("int").alias("kind"), "sampled"), "kinds")

    nothing = pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "packed": pa.array([], pa.binary())})
    message = "chunk long, bucket long, packed binary"

    def kinds_of(right: pa.Table, rows: int) -> np.ndarray:
        kind = np.full(rows, -1)
        kind[right.column("pos").to_numpy()] = right.column("kind").to_numpy()
        return kind

    def hashes_of(vocabulary: bytes) -> np.ndarray:
        return np.cumsum(_from_planes(_unpack(vocabulary)[0]), dtype=np.uint64)

    def ask_numbers(left, right):
        for chunk, ids, vocabulary, packed in zip(*(left.column(c).to_pylist() for c in ("chunk", "ids", "vocabulary", "packed")), strict=True):
            words, sizes = (_from_planes(x).astype(np.int64) for x in _unpack(packed))
            seen = np.bincount(words[np.repeat(kinds_of(right, len(ids)) >= 0, sizes)], minlength=len(hashes_of(vocabulary))) > 0
            return messages(chunk, hashes_of(vocabulary), seen[None], 64, word_buckets)
        return nothing

    def take_numbers(left, right):
        out = {"chunk": [], "numbers": [], "top": []}
        for chunk, vocabulary in zip(left.column("chunk").to_pylist(), left.column("vocabulary").to_pylist(), strict=True):
            _, place = np.unique(hashes_of(vocabulary), return_inverse=True)
            got = numbers(right, word_buckets)[place]
            for x, v in zip(out, (chunk, _pack(_planes(got)), int(got.max(initial=0))), strict=True):
                out[x].append(v)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "numbers": pa.array(out["numbers"], pa.binary()), "top": pa.array(out["top"], pa.int64())})

    # what asks and what answers are small beside the chunks: the words of each, once
    by = spelt.groupBy("chunk").cogroup(kinds.groupBy("chunk")).applyInArrow(ask_numbers, message).groupBy("bucket").applyInArrow(ranks, message)
    numbered = tables.write(spelt.select("chunk", "vocabulary").groupBy("chunk").cogroup(by.groupBy("chunk")).applyInArrow(take_numbers, "chunk long, numbers binary, top long"))
    width = max(2, int(numbered.agg(F.max("top")).first()[0] or 0).bit_length())
    if width > 32:
        raise OverflowError("training texts hold more than 2^32 words")
    coded = spelt.drop("vocabulary").join(numbered.drop("top").hint("merge"), "chunk")

    def unpacked(left: pa.Table):
        """(chunk, ids, Pairs) of a chunk's row."""
        for chunk, ids, packed, number in zip(*(left.column(c).to_pylist() for c in ("chunk", "ids", "packed", "numbers")), strict=True):
            words, sizes = (_from_planes(x).astype(np.int64) for x in _unpack(packed))
            yield chunk, ids, Pairs(_from_planes(_unpack(number)[0]), words, sizes, width)

    def ask(left, right):
        for chunk, ids, p in unpacked(left):
            return messages(chunk, p.keys, p.counts(kinds_of(right, len(ids))), 2 * width, pair_buckets)
        return nothing

    def ask_words(left, right):
        for chunk, _, p in unpacked(left):
            found = p.all_pairs(gathered(right, p.keys))
            n, owned = found[:2], found[-1] > 0
            seen = [[(owned & (n[c] == i)).sum() for i in (1, 2)] for c in (0, 1)]
            told = pa.table({"chunk": pa.array([chunk]), "bucket": pa.array([-1]), "packed": pa.array([np.array(seen, ">i8").tobytes()], pa.binary())})
            return pa.concat_tables([messages(chunk, p.unit_keys(), p.unit_counts(n, owned).T, width, word_buckets), told])
        return nothing

    def answer_words(key, table):
        out = answers(key, table)
        summed = totals(table.column("packed").to_pylist())[3]
        told = np.concatenate([summed[4:].sum(1), (summed[4:] > 0).sum(1)]).astype(">i8").tobytes()
        return pa.concat_tables([out, pa.table({"chunk": pa.array([-1]), "bucket": table.column("bucket")[:1], "packed": pa.array([told], pa.binary())})])

    def together(df: DataFrame) -> np.ndarray:
        """Sums of small arrays of big-endian numbers, one a chunk or bucket, added in Spark."""
        at = lambda i: F.conv(F.hex(F.substring("packed", 8 * i + 1, 8)), 16, 10).cast("long")
        n = len(_UNIT[4:]) * 2
        first = df.agg(*[F.sum(at(i)) for i in range(n)]).first()
        return np.array([x or 0 for x in first], np.int64)

    by = coded.groupBy("chunk")
    asked = by.cogroup(kinds.groupBy("chunk")).applyInArrow(ask, message)
    # a bucketed table beside the chunks: its two readers don't shuffle it again
    pairs = tables.write(asked.groupBy("bucket").applyInArrow(answers, message).repartition(tables.buckets, "chunk"))
    wanted = written(by.cogroup(pairs.groupBy("chunk")).applyInArrow(ask_words, message), "words")
    discount = discounts(together(wanted.where("bucket = -1").withColumn("packed", F.concat("packed", F.lit(b"\0" * 16))))[:4].reshape(2, 2))
    units = written(wanted.where("bucket >= 0").groupBy("bucket").applyInArrow(answer_words, message), "units")
    every = together(units.where("chunk = -1"))
    forget(wanted)

    def assemble(left, right):
        out = {"doc_id": [], "found": [], "loglen": [], "own": []}
        of = {w: right.filter(pa.compute.equal(right.column("what"), w)) for w in ("kind", "word")}
        for (_, ids, p), back in zip(unpacked(left), left.column("replies"), strict=True):
            n = p.all_pairs(gathered(pa.Table.from_struct_array(back.values) if back.is_valid else nothing, p.keys)[:2] if len(p.keys) else np.zeros((2, 0), np.int64))
            unit = gathered(of["word"].select(["bucket", "packed"]), p.unit_keys())[:-1]
            value = summaries(n, unit[:4, p.before], unit[4:, p.word], every, discount)
            told = dict(zip(of["kind"].column("bucket").to_pylist(), of["kind"].column("kind").to_pylist(), strict=True))
            for i, doc in enumerate(ids):
                cut = np.s_[p.first[i] : p.first[i + 1]]
                cells, times, mine, own = p.cells[cut], p.times[cut], told.get(i), None
                mean = (lambda x, t=times: x @ t / t.sum()) if len(cells) else (lambda x: np.zeros(len(FEATURES)))
                if mine is not None:
                    a, b = p.before[cells], p.word[cells]
                    own = mean(summaries(*without_own(mine, n[:, cells], unit[:4, a], unit[4:, b], every, a, b), discount))
                for x, v in zip(out, (doc, mean(value[:, cells]), math.log1p(times.sum()), own), strict=True):
                    out[x].append(v)
        types = {"doc_id": pa.int64(), "loglen": pa.float64()}
        return pa.table({x: pa.array(v, types.get(x, pa.list_(pa.float64()))) for x, v in out.items()})

    none, no_kind = F.lit(None).cast("binary"), F.lit(None).cast("int")
    right = (
        kinds.where("sampled").select("chunk", F.lit("kind").alias("what"), F.col("pos").cast("long").alias("bucket"), none.alias("packed"), "kind")
        .unionByName(units.where("chunk >= 0").select("chunk", F.lit("word").alias("what"), "bucket", "packed", no_kind.alias("kind")))
    )
    # one row a chunk on both sides, joined where they lie
    replies = pairs.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "packed")).alias("replies"))
    held = coded.join(replies.hint("merge"), "chunk", "left")
    features = written(held.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(assemble, "doc_id long, found array<double>, loglen double, own array<double>"), "toxicity")
    forget(kinds, units)
    return features, discount


def design(found: np.ndarray, loglen: np.ndarray) -> np.ndarray:
    """Columns of the curve from found [texts, features]: the means, also as totals on a square-root scale, which short and long texts share."""
    root = np.sqrt(np.expm1(loglen))
    return np.concatenate([np.ones((len(loglen), 1)), found * 100, found * root[:, None], loglen[:, None]], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalised logistic regression by Newton steps on standardised columns; the first column is constant."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale = 0.0, np.where(scale > 1e-12, scale, 1.0)
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Probability that labels mark a text as toxic, for every row of docs.

    Learns from rows of docs that are not held out and whose id has a label of 0
    or 1 (null labels teach nothing; an id with different labels counts as
    toxic).  Returns one row per input row: doc_id, held_out, score, predicted,
    ratio (the difference of the length-normalised log-likelihoods).  Null texts
    are empty; empty texts get the score of their features, all 0.  If one of
    the labels is missing, all scores are the share of toxic labels (0.0 without
    labels).  Repeated rows and null ids are kept, repeated training rows count
    each.  Other columns are ignored; an empty table gives an empty result.
    features: what the curve sees, of FEATURES; ("ratio",) is the difference alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("kind")).where("kind in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("kind").alias("kind")).where(~held_out("doc_id"))
    n, k = marks.agg(F.count("*"), F.sum("kind")).first()
    # the sample is a threshold on a hash, so no partition sends more than its share of it
    share = min(1.0, 0.95 * CALIBRATION_ROWS / n) if n else 0.0
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    measured, _ = text_features(rows, marks.withColumn("sampled", chosen))
    used = [FEATURES.index(x) for x in features]
    own = measured.where("own is not null").join(marks.hint("merge"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "own", "loglen").limit(CALIBRATION_ROWS)
    found = np.array([(*own_, size, kind) for own_, size, kind in own.select("own", "loglen", "kind").collect()], float).reshape(-1, len(FEATURES) + 2)
    y = found[:, -1]
    if len(set(y)) < 2:
        score = F.lit(float(k or 0) / n if n else 0.0)
    else:
        w, mean, scale = fit_logistic(design(found[:, used], found[:, -2]), y)
        w = w / scale
        w[0] -= float((w * mean)[1:].sum())
        means, root = [F.col("found")[i] for i in used], F.sqrt(F.expm1("loglen"))
        terms = [F.lit(1.0), *[x * 100 for x in means], *[x * root for x in means], F.col("loglen")]
        z = sum((F.lit(float(a)) * t for a, t in zip(w, terms, strict=True)), F.lit(0.0))
        score = 1 / (1 + F.exp(-z))
    return measured.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("found")[0].alias("ratio"))


def accuracy(truth: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    """Accuracy at 0.5 and area under the curve."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    k = int(truth.sum())
    area = (rank[truth > 0].sum() - k * (k + 1) / 2) / (k * (len(truth) - k)) if 0 < k < len(truth) else math.nan
    return float(((score >= 0.5) == (truth > 0)).mean()), float(area)
