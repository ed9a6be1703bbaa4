"""Byte-level BPE by a distinct-word table.

Texts are dealt to chunks by a hash of their content.  Each chunk lists its
distinct words once; the words of all chunks meet by word hash, where every
distinct word of the corpus is encoded exactly once; the ids go back to the
chunks that asked, in the order of the words that they sent, and are joined to
the texts by position.  Decoding looks every id up in the id-to-piece table,
whose size is that of the vocabulary, and concatenates the pieces.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of the vocabulary's own pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that a chunk holds on average.
CHUNK_BYTES = 16_000_000
#: Bytes of text for which there is a bucket of the distinct-word table.
BUCKET_BYTES = 128_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: its own where printable, else from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: splits texts, encodes words and holds the pieces of the ids."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(text)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.plain = regex.compile(PATTERN).findall
        value = {c: b for b, c in enumerate(byte_symbols())}
        size = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
        pieces = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            pieces[i] = bytes(value[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(x) for x in pieces], np.int64)
        self.piece_at = np.r_[0, np.cumsum(self.piece_len)]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens; where the two Unicode versions may differ, by the library's own splitter."""
        if any(map(newer, set(text))):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.plain(text)

    def words(self, text: str) -> list[str]:
        """The words of a text; strings of special tokens are words of their own, found before all else."""
        if self.cut is None or not any(x.decode() in text for x in self.special):
            return self.split(text)
        out = []
        for part in self.cut.split(text):
            if part.encode() in self.special:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Pieces of the ids, joined; bytes that aren't UTF-8 become U+FFFD."""
        raw = gather(self.piece_bytes, self.piece_at[ids], self.piece_len[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(1 << 16)
def newer(character: str) -> bool:
    """True for characters that were assigned late or not at all, on whose class Unicode versions may differ."""
    return character > "\u024f" and unicodedata.ucd_3_2_0.category(character) == "Cn"


@functools.lru_cache(1)
def _vocabulary(text: str) -> Vocabulary:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(text)


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[at[i] : at[i] + size[i]] behind one another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(at - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(total)]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, text, chunk: texts dealt by a hash of the row, about CHUNK_BYTES to a chunk; and how many buckets their words get."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, total // CHUNK_BYTES)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    # equal rows are spread by a digest of the id, equal ids by their texts
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), buckets


#: Marks that are words of their own after letters; an apostrophe isn't one of them.
_MARKS = tuple(".,;:!?")


def _no_cycles(f):
    """f without the cycle collector, which would only walk over millions of strings."""

    def run(left, right):
        gc.disable()
        try:
            return f(left, right)
        finally:
            gc.enable()

    return run


class Split:
    """The words of a chunk's texts.

    A space between two characters that aren't white space always starts a
    word, so texts are cut there first and each distinct piece is split once.
    Texts in which white space meets such a cut, or with special tokens, are
    split as a whole.
    """

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        self.texts = texts
        self.whole: dict[int, list[str]] = {}
        heads: set[str] = set()
        tails: set[str] = set()
        special = [x.decode() for x in vocabulary.special]
        for i, text in enumerate(texts):
            if any(x in text for x in special):
                self.whole[i] = vocabulary.words(text)
                continue
            parts = text.split(" ")
            heads.add(parts[0])
            parts[0] = parts[-1] if len(parts) > 1 else ""
            tails.update(parts)
        tails.discard("")
        odd_head = {p for p in heads if p and p[-1].isspace()}
        odd = {p for p in tails if p[0].isspace() or p[-1].isspace()}
        if any(map(newer, set().union(*heads, *tails))):
            odd_head |= {p for p in heads if any(map(newer, p))}
            odd |= {p for p in tails if any(map(newer, p))}
        for i, text in enumerate(texts):
            if i in self.whole:
                continue
            if "  " in text or text.endswith(" "):
                self.whole[i] = vocabulary.split(text)
            elif odd or odd_head:
                parts = text.split(" ")
                if parts[0] in odd_head or not odd.isdisjoint(parts[1:]):
                    self.whole[i] = vocabulary.split(text)

        def plain(space: str, p: str) -> list[str]:
            if p.isalpha():  # letters, and letters before one mark, are most of the pieces
                return [space + p]
            if p[-1:] in _MARKS and p[:-1].isalpha():
                return [space + p[:-1], p[-1]]
            return vocabulary.plain(space + p)

        self.heads = {p: plain("", p) for p in heads - odd_head}
        self.tails = {p: plain(" ", p) for p in tails - odd}

    def words(self) -> list[str]:
        """All distinct words, sorted."""
        found: set[str] = set()
        for part in (self.heads, self.tails, self.whole):
            for w in part.values():
                found.update(w)
        return sorted(found)

    def token_ids(self, words: list[str], flat: np.ndarray, at: np.ndarray, size: np.ndarray):
        """Ids of every text in order, from the words' ids flat[at : at + size]."""
        index = dict(zip(words, range(len(words)), strict=True))
        lists = [*self.heads.values(), *self.tails.values()]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        w = np.fromiter((index[x] for ws in lists for x in ws), np.int64, int(n.sum()))
        piece_flat = gather(flat, at[w], size[w])
        ends = np.r_[0, np.cumsum(size[w])][np.r_[0, np.cumsum(n)]]
        head = dict(zip(self.heads, range(len(self.heads)), strict=True))
        tail = dict(zip(self.tails, range(len(self.heads), len(lists)), strict=True))
        start, long = ends[:-1], np.diff(ends)
        for i, text in enumerate(self.texts):
            if i in self.whole:
                w = np.fromiter(map(index.__getitem__, self.whole[i]), np.int64, len(self.whole[i]))
                yield gather(flat, at[w], size[w])
            else:
                parts = text.split(" ")
                p = np.empty(len(parts), np.int64)
                p[0] = head[parts[0]]
                p[1:] = np.fromiter(map(tail.__getitem__, parts[1:]), np.int64, len(parts) - 1)
                yield gather(piece_flat, start[p], long[p])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind one another, with their byte lengths, compressed."""
    raw = [a.tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    body = b"".join([head, *raw])
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=4).compress(body, asbytes=True)


def _unpack(packed: bytes) -> list[bytes]:
    body = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(body, "<i8", n, 8))]
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _bucket_of(words: list[str], buckets: int) -> np.ndarray:
    from . import bytewords as bw

    nothing = np.zeros(256, bool)
    data, offsets = bw.buffers(pa.array(words, pa.string()))
    hashes, first = bw.word_hashes(data, offsets, nothing, np.arange(256, dtype=np.uint8))
    if len(hashes) != len(words):  # a word of over a megabyte comes in pieces
        hashes = hashes[first[:-1]]
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _replies(rows: DataFrame, shared, buckets: int) -> DataFrame:
    def ask(key, table):
        words = Split(table.column("text").to_pylist(), _vocabulary(shared.value)).words()
        out = {"chunk": [], "bucket": [], "words": []}
        if words:
            bucket = _bucket_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                raw = [words[i].encode() for i in order[a:b]]
                out["chunk"].append(key[0].as_py())
                out["bucket"].append(int(bucket[order[a]]))
                out["words"].append(_pack(np.fromiter(map(len, raw), np.int32, len(raw)), np.frombuffer(b"".join(raw), np.uint8)))
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary())]))

    def answer(key, table):
        lists = []
        for packed in table.column("words").to_pylist():
            sizes, raw = _unpack(packed)
            offsets = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int32))].astype(np.int32)
            lists.append(pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids = _vocabulary(shared.value).encode(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, at = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), np.cumsum(size) - size
        which, offsets = coded.indices.to_numpy(), np.r_[0, np.cumsum([len(x) for x in lists])]
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            w = which[a:b]
            out.append(_pack(size[w].astype(np.int32), gather(flat, at[w], size[w])))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ids": pa.array(out, pa.binary())})

    asked = rows.groupBy("chunk").applyInArrow(_no_cycles(ask), "chunk long, bucket long, words binary")
    return asked.groupBy("bucket").applyInArrow(_no_cycles(answer), "chunk long, bucket long, ids binary")


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text and their decoding, as digests (and the ids themselves with keep_ids).

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8); with
    keep_ids also ids array<int> and decoded.  A null text is empty: no ids.
    Strings of the vocabulary's special tokens become their ids.  Rows with a
    null or repeated doc_id are all kept, one result each.  Other columns are
    ignored.  Empty tables give empty results.  A chunk holds some megabytes, or
    one text where that is longer.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    rows, buckets = _chunked(docs, id_col, text_col)

    def assemble(left, right):
        vocabulary = _vocabulary(shared.value)
        split = Split(left.column("text").to_pylist(), vocabulary)
        words = split.words()
        flat, at, size = np.zeros(0, np.int32), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if words:
            order = np.argsort(_bucket_of(words, buckets), kind="stable")  # the order in which the words were sent
            reply = [_unpack(x) for x in right.sort_by("bucket").column("ids").to_pylist()]
            got = np.concatenate([np.frombuffer(x, np.int32) for x, _ in reply]).astype(np.int64)
            flat = np.concatenate([np.frombuffer(x, np.int32) for _, x in reply])
            if len(got) != len(words):
                raise RuntimeError("a chunk's words and their ids differ in number")
            size[order], at[order] = got, np.cumsum(got) - got
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep_ids else {})
        for ids in split.token_ids(words, flat, at, size):
            decoded = vocabulary.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                out["ids"].append(ids)
                out["decoded"].append(decoded.decode())
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({"doc_id": left.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return rows.groupBy("chunk").cogroup(_replies(rows, shared, buckets).groupBy("chunk")).applyInArrow(_no_cycles(assemble), schema)
