"""PNG in binary columns: chunks with checksum tests, numpy unfiltering, and low-frequency cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: An image row: 64 pixels of three 8-bit samples.
WIDTH, CHANNELS = 64, 3
#: Bytes of images after which a slice is closed.
SLICE_BYTES = 64 << 20
ROW = WIDTH * CHANNELS
LEVEL = 2
#: Rows that are filtered at once, so that what a long text takes beside its own bytes is bounded.
FILTER_ROWS = 4096
#: Most bytes of compressed data in one IDAT chunk.
IDAT_BYTES = 1 << 16
#: Side of the picture that is transformed, and of the low-frequency square that is kept.
SIDE, LOW = 32, 8


class MediaError(ValueError):
    """The bytes aren't a PNG that this module reads, or are damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with their filter byte: none, left difference or upper difference, whichever has the least sum of small signed values."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for at in range(0, len(rows), FILTER_ROWS):
        block = rows[at : at + FILTER_ROWS]
        up = block.copy()
        up[1:] -= block[:-1]
        if at:
            up[0] -= rows[at - 1]
        left = block.copy()
        left[:, bpp:] -= block[:, :-bpp]
        forms = np.stack([block, left, up])
        cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(2)
        best = cost.argmin(0)
        out[at : at + FILTER_ROWS, 0] = best
        out[at : at + FILTER_ROWS, 1:] = forms[best, np.arange(len(block))]
    return out


def encode_png(payload: bytes, width: int = WIDTH, channels: int = CHANNELS, level: int = LEVEL) -> bytes:
    """A PNG whose 8-bit samples are the payload's bytes; their number is a multiple of width * channels."""
    row = width * channels
    if not payload or len(payload) % row:
        raise MediaError("the payload doesn't fill whole rows")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row)
    data = zlib.compress(filter_rows(rows, channels).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    parts = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfilter_rows(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the filters of rows that start with their filter byte; all five kinds."""
    kind, rows = raw[:, 0], raw[:, 1:].copy()
    n, width = rows.shape
    if (kind > 4).any():
        raise MediaError("unknown filter")
    left = np.flatnonzero(kind == 1)
    rows[left] = np.cumsum(rows[left].reshape(len(left), width // bpp, bpp), 1, dtype=np.uint8).reshape(len(left), width)
    at = 0
    while at < n:
        if kind[at] < 2:
            at += 1
            continue
        if kind[at] == 2:  # a run of upper differences is a running sum down the columns
            to = at
            while to < n and kind[to] == 2:
                to += 1
            if at:
                rows[at] += rows[at - 1]
            rows[at:to] = np.cumsum(rows[at:to], 0, dtype=np.uint8)
            at = to
            continue
        above = rows[at - 1].astype(int) if at else np.zeros(width, int)
        cur = rows[at].astype(int)
        for x in range(0, width, bpp):
            a = cur[x - bpp : x] if x else np.zeros(bpp, int)
            b = above[x : x + bpp]
            if kind[at] == 3:
                guess = (a + b) // 2
            else:
                c = above[x - bpp : x] if x else np.zeros(bpp, int)
                p = a + b - c
                pa_, pb_, pc_ = abs(p - a), abs(p - b), abs(p - c)
                guess = np.where((pa_ <= pb_) & (pa_ <= pc_), a, np.where(pb_ <= pc_, b, c))
            cur[x : x + bpp] = (cur[x : x + bpp] + guess) & 255
        rows[at] = cur
        at += 1
    return rows


def decode_png(media: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, channels and samples; every chunk's checksum is tested.

    Reads 8-bit grey, RGB, grey with alpha and RGBA without interlacing.  Chunks
    that it doesn't know are passed over if they are ancillary.
    """
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, data = 8, None, []
    while True:
        if at + 12 > len(media):
            raise MediaError("the file ends inside a chunk")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise MediaError(f"chunk {kind!r} is damaged")
        at += 12 + n
        if kind == b"IHDR":
            if n != 13:
                raise MediaError("the header has another length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        elif not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[4:] != (0, 0, 0):
        raise MediaError("unsupported image kind")
    if not head[0] or not head[1]:
        raise MediaError("an image without pixels")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != head[1] * (head[0] * channels + 1):
        raise MediaError("wrong number of samples")
    rows = unfilter_rows(raw.reshape(head[1], -1), channels)
    return head[0], head[1], channels, rows.tobytes()


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def cosine_hash(samples: np.ndarray) -> str:
    """64-bit hash, as hex, of an image [height, width, channels]: signs of its low frequencies about their median."""
    grey = samples.sum(2, dtype=np.int64)

    def shrink(x):
        n = len(x)
        total = np.zeros((n + 1, x.shape[1]), np.int64)
        np.cumsum(x, 0, out=total[1:])
        lo = np.arange(SIDE) * n // SIDE
        hi = np.maximum(lo + 1, (np.arange(SIDE) + 1) * n // SIDE)
        return (total[hi] - total[lo]), (hi - lo)

    rows, h = shrink(grey)
    cells, w = shrink(np.ascontiguousarray(rows.T))
    small = cells.T / (h[:, None] * w[None])
    c = _cosines()
    low = np.round(c @ small @ c.T, 6)
    bits = low.ravel() > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with spaces to whole rows, as a PNG in a binary column.

    Null texts are empty; the least payload is one row.  Bytes that aren't UTF-8
    are stored as they are.  Repeated rows and null
    ids are kept; other columns are ignored; empty tables give empty results.
    Images leave a task in slices of 1,000 or of SLICE_BYTES, so that only a
    single one must stay below 2 GB.
    """

    def run(batches):
        for b in batches:
            ids, texts, at, sizes, media, held = b.column(0), b.column(1), 0, [], [], 0
            for i in range(b.num_rows):
                x = texts[i].as_py() or b""
                sizes.append(len(x))
                media.append(encode_png(x.ljust(max(1, -(-len(x) // ROW)) * ROW, b" ")))
                held += len(media[-1])
                if len(sizes) == 1000 or held >= SLICE_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    at, sizes, media, held = i + 1, [], [], 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the binary column media back: samples' length and digests, the stored form's, and the cosine hash; n_bytes and doc_id pass through.

    A null or damaged image gives null features and its reason in error.
    """

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(2).to_pylist():
                try:
                    if x is None:
                        raise MediaError("no image")
                    width, height, channels, samples = decode_png(x)
                    hashed = cosine_hash(np.frombuffer(samples, np.uint8).reshape(height, width, channels))
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(x), hashlib.sha256(x).hexdigest(), hashed, None))
                except MediaError as e:
                    rows.append((None, None, None, None if x is None else len(x), None if x is None else hashlib.sha256(x).hexdigest(), None, str(e)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
