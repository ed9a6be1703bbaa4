"""WARC archives: writing with segmented, chunked responses and revisits, and reading with segment reassembly.

A payload longer than a segment is written as a response with segment number 1
and continuation records that name it as their origin.  Reading groups the
segments by origin, orders them by number, tests the total length and takes the
chunked transfer framing off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete_path, forget, frequent, new_path, salted_join, written

VERSION = b"WARC/1.1"
#: Bytes of a record's block, at most, and of a chunk of the transfer framing.
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Records in an archive file, at most: with the segments' length, 128 MB before compression.
FILE_RECORDS = 8_000
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or a record breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise WarcError("a chunk has no size")
        try:
            n = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError("a chunk's size isn't a number") from e
        if n < 0:
            raise WarcError("a chunk's size isn't a number")
        at = line + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise WarcError("a chunk has another length")
        parts.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block), b"", block]
    return b"\r\n".join(lines)


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}>"


def page_records(page_id: int | None, key: str, url: str | None, payload: bytes, refers_to: str | None = None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without the empty lines that end them.

    key is unique to the page's row and gives the record's id; refers_to is the
    key of the response that the page revisits, None for a response.
    """
    name = record_id(key)
    head = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    http = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record([*kind, *head, ("WARC-Refers-To", record_id(refers_to)), http], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame_chunks(payload)
    head = [("WARC-Type", "response"), *head, http]
    if len(block) <= segment:
        return [_record(head, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    records = [_record([*head, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{key}/{i}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i))]
        records.append(_record([*more, *([("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else [])], part))
    return records


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Write a record per row into gzip archive files under path, through Spark's own text writer.

    Of rows with equal payloads of at least least_bytes bytes those with the
    smallest page_id are responses, the others revisit it; null ids come last
    and are responses only where no row with that payload has an id.  Repeated
    rows with the response's id are responses themselves; revisits name one of
    them.  Every row gets a record id of its own, however equal rows are.  Null
    bodies are empty; null URLs are written as empty.  Other columns are
    ignored; an empty table gives no records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("html"))
    # the key is drawn once and written, so that a response and its revisits agree on it
    rows = written(rows.select(F.monotonically_increasing_id().alias("key"), "*", F.sha1(F.encode("html", "utf-8")).alias("sha")), "pages")
    # equal payloads: only digests, ids and keys are shuffled for this, and reduced before
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("response"), F.col("key").alias("response_key"))).alias("x")
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(least, F.count("*").alias("rows")).where("rows > 1").select("sha", "x.response", "x.response_key")
    both = salted_join(rows, first, "sha", frequent(rows.select("sha"), "sha"), F.col("key"))
    alone = F.col("response_key").isNull() | F.col("page_id").eqNullSafe(F.col("response"))
    both = both.select("key", "page_id", "url", "html", F.when(~alone, F.col("response_key")).alias("refers"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = []
                for key, page, url, html, refers in zip(*(c.to_pylist() for c in b.slice(at, 200).columns), strict=True):
                    out += page_records(page, str(key), url, html.encode(), None if refers is None else str(refers), segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the bytes go to the file as they are: a cast from binary to string doesn't touch them
    records = both.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)
    forget(rows)


def open_archive(content: bytes):
    """A binary stream of an archive file, gzip (of any number of members) or plain; it is inflated while it is read."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if content[:2] == b"\x1f\x8b" else raw


def parse_archive(stream):
    """(headers with lower-case names, block) of every record of an archive stream; WarcError where the archive is damaged."""
    try:
        while first := stream.readline():
            if not first.startswith(b"WARC/"):
                if first.strip() or stream.read().strip():
                    raise WarcError("a record doesn't start with its version")
                return
            headers = {}
            while (line := stream.readline()) != b"\r\n":
                if not line.endswith(b"\n"):
                    raise WarcError("the file ends inside a header")
                name, _, value = line.partition(b":")
                headers[name.strip().lower().decode()] = value.strip().decode()
            n = number(headers.get("content-length", "0"))
            block = stream.read(n)
            if len(block) != n or stream.read(4) != b"\r\n\r\n":
                raise WarcError("a record has another length")
            yield headers, block
    except (EOFError, OSError, zlib.error, UnicodeDecodeError) as e:
        raise WarcError("the archive can't be inflated or decoded") from e


def number(text: str | None) -> int | None:
    """A decimal number that fits a long; null stays null."""
    if text is None:
        return None
    if not text.isascii() or not text.isdigit() or len(text) > 18:
        raise WarcError("a header's number isn't one")
    return int(text)


_KINDS = [("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()),
          ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path: type, ids, segment numbers, digests and blocks.

    A damaged archive gives the records before the damage and one row with the
    reason in error, all else null.  A record whose own numbers are broken gives
    such a row with its record id, and reading goes on behind it.
    """

    def fields(h, block):
        page = h.get("x-page-id")
        sign = -1 if page is not None and page.startswith("-") else 1
        page = number(page if sign > 0 else page[1:])
        return (h.get("warc-type"), h.get("warc-record-id"), page if page is None else sign * page, h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                h.get("warc-refers-to"), h.get("warc-segment-origin-id") or h.get("warc-record-id"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), block, None)

    def broken(e, name=None):
        return (None, name, *[None] * 8, str(e))

    def rows_of(content):
        try:
            for h, block in parse_archive(open_archive(content.as_buffer().to_pybytes())):
                try:
                    yield fields(h, block)
                except WarcError as e:
                    yield broken(e, h.get("warc-record-id"))
        except WarcError as e:
            yield broken(e)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in rows_of(content):
                    rows.append(r)
                    size += len(r[9] or b"") + 500
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "record_type string, record_id string, page_id long, url string, digest string, refers string, origin string, segment long, total long, block binary, error string"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def _payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("the response has no header end")
    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")[1:])
    return unframe_chunks(body) if chunked else body


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, page_id, url, record_type, refers, payload_digest, payload_bytes, payload, error: one row per response, revisit or damage.

    Segments meet by origin and go by number; numbers must run from 1 without
    gaps, repeated numbers must be equal, and the last must state the length of
    all.  Records that aren't segmented aren't shuffled with them.  A revisit
    has the digest that it states and no payload of its own; see
    resolve_revisits.  A broken record keeps its row with the reason in error.
    """
    names = ["record_type", "record_id", "page_id", "url", "digest", "refers", "error"]
    whole = records.where("segment is null and (record_type in ('response', 'revisit') or error is not null)").select(*names, F.array("block").alias("blocks"))
    parts = records.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block", "total"))).alias("parts"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "digest")],
    )
    n = F.size("parts")
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    right = (F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1).cast("long"), n.cast("long"))) & (F.element_at("parts", -1)["total"] == length)
    none = F.lit(None).cast("string")
    joined = parts.select(F.lit("response").alias("record_type"), F.col("origin").alias("record_id"), "page_id", "url", "digest", none.alias("refers"), none.alias("error"), F.when(F.coalesce(right, F.lit(False)), F.transform("parts", lambda x: x["block"])).alias("blocks"))
    rows = whole.unionByName(joined)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, out = b.slice(at, 200), []
                for kind, want, error, blocks in zip(*(part.column(c).to_pylist() for c in (0, 4, 6, 7)), strict=True):
                    if error is not None or kind == "revisit":
                        out.append((want, None, None, error))
                        continue
                    try:
                        if blocks is None:
                            raise WarcError("segments are missing or have another length")
                        payload = _payload(b"".join(blocks))
                        found = digest(payload)
                        if want is not None and found != want:
                            raise WarcError("the payload has another digest")
                        out.append((found, len(payload), payload, None))
                    except WarcError as e:
                        out.append((None, None, None, str(e)))
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), part.column(0), part.column(5), *(pa.array([x[j] for x in out], k) for j, k in enumerate((pa.string(), pa.int64(), pa.binary(), pa.string())))],
                                                     names=["record_id", "page_id", "url", "record_type", "refers", "payload_digest", "payload_bytes", "payload", "error"])

    return rows.mapInArrow(run, "record_id string, page_id long, url string, record_type string, refers string, payload_digest string, payload_bytes long, payload binary, error string")


def resolve_revisits(found: DataFrame) -> DataFrame:
    """found with revisits joined to the responses that they name: refers_to is the response's page_id, payload_bytes its length.

    A revisit whose response is missing or has another digest gets the reason in
    error.  found is read more than once and should be a written table; no
    payloads are needed.
    """
    asked, rest = found.where("record_type = 'revisit'"), found.where("record_type <> 'revisit' or record_type is null")
    known = found.where("record_type = 'response' and error is null").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).dropDuplicates(["refers"])
    both = salted_join(asked, known, "refers", frequent(asked.select("refers"), "refers"), F.col("record_id"))
    why = F.when(F.col("_bytes").isNull(), "the response that is referred to is missing").when(F.col("_digest") != F.col("payload_digest"), "the response that is referred to has another digest")
    columns = ["page_id", "url", "record_type", "payload_digest", "error"]
    revisits = both.withColumn("error", F.coalesce("error", why)).select(*columns, F.when(F.col("error").isNull(), F.col("_bytes")).alias("payload_bytes"), F.when(F.col("error").isNull(), F.col("refers_to")).alias("refers_to"))
    return rest.select(*columns, "payload_bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages as archives into the shared folder, read them back and return the reassembled records without payloads.

    Options and the handling of nulls, empty texts and repeated rows are those
    of write_archives; one row comes back for each row that went in.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, **options)
    found = written(reassemble(read_records(spark, path)).drop("payload"), "records")
    delete_path(spark, path)
    return resolve_revisits(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")
