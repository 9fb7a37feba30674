"""WARC archives: writing records, revisits and continuation segments, and putting segmented records together again.

Each task parses whole archive files, once. A record that isn't segmented is complete there: its HTTP block is parsed, its
chunked transfer framing decoded and its payload held against the stated length and digest in place, and only what it
says goes on. Continuation records are grouped by their origin's identifier, ordered by segment number, joined, held
against the total length that the last segment states, and then decoded and checked in the same way. Only segments are
shuffled. A group is one record, so it is as large as one payload and no larger.

Archives hold one gzip member a record. Tasks write files under names of their own and report them in a manifest table;
only files in the manifest are read, so what a lost attempt wrote doesn't count.

Defined results: a null payload is an empty one, a null url an empty header; payloads below ``REVISIT_BYTES`` never become
revisits; rows that repeat an id are written one by one, the responses of equal payloads being all rows of their smallest
id, which the others revisit (a row without an id too, unless none has one: then all are responses); texts are written
whole, however long; columns beside id, url and payload are left out, whatever their names. A group with a missing segment, a second copy of one, or another total length raises an error that names its origin.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_dir, small_batches, stored

REVISIT_BYTES = 100
#: Bytes of a record's block beyond which it goes on in continuation records, and of an archive file.
SEGMENT_BYTES = 32 << 10
FILE_BYTES = 64 << 20
#: Bytes of segments or payloads that the reader holds before it passes them on.
READ_BYTES = 1 << 20
CHUNK_BYTES = 4 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
RECORD = "kind string, origin string, segment int, total long, url string, page string, digest string, refers string, length long, data binary"


class Damaged(ValueError):
    """An archive that breaks off, or segments that don't make up their record."""


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [body[k : k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body in chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise Damaged("chunk size without end")
        size = int(data[at:end].split(b";")[0].strip() or b"0", 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != CRLF:
            raise Damaged("chunk shorter than its size")
        out.append(data[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, out of its transfer framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise Damaged("HTTP headers without end")
    fields = [line.lower().split(b":", 1) for line in head.split(CRLF)[1:]]
    if any(f[0].strip() == b"transfer-encoding" and b"chunked" in f[1] for f in fields if len(f) == 2):
        return unchunked(body)
    return body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + CRLF + block + CRLF + CRLF) + packer.flush()


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def records(page: str, url: str, payload: bytes, digest: str, refers: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a response, in segments if it is long, or a revisit."""
    origin = uuid.uuid4().urn
    common = [("WARC-Date", DATE), ("WARC-Target-URI", clean(url)), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{origin}>"), *common, ("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers), ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{origin}>"), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield record(first, block)
        return
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at : at + segment_bytes]
        total = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment_bytes >= len(block) else []
        if n == 1:
            yield record([*first, ("WARC-Segment-Number", "1")], part)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Segment-Number", str(n)), *total], part)


def parse(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of a file's records; holds one gzip member at a time."""
    held = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not held:
                held = source.read(1 << 20)
                if not held:
                    if parts:
                        raise Damaged("the archive breaks off")
                    return
            parts.append(inflate.decompress(held))
            held = inflate.unused_data
        yield one_record(b"".join(parts))


def one_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise Damaged("not a record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise Damaged("a block shorter than its length")
    return fields, rest[:n]


def reassembled(parts: list[tuple[int, int | None, bytes]], origin: str) -> bytes:
    """Segments (number, total length or None, block) of one record, joined after all checks."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise Damaged(f"segments {[p[0] for p in parts][:9]} of {origin}")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise Damaged(f"{len(block)} bytes of {parts[-1][1]} of {origin}")
    return block


def with_responses(pages: DataFrame, payload: str = "html", page_id: str = "page_id", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), digest, refers (the id of the response that the page repeats, or null).

    The smallest id of each digest that occurs again is found by partial sums and stored. Pages then meet these rows by
    digest. The table's size is known by then, so Spark moves it to the pages while it is below its broadcast threshold,
    and payloads stay where they are; beyond it both sides are shuffled, and adaptive execution splits hot digests (all
    pages are on one side).
    """
    pages = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    again = pages.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = stored(again.select(F.col("digest").alias("_d"), "_first"), "responses")
    out = pages.join(again, F.col("digest") == F.col("_d"), "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers"))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes page_id, url, payload, digest, refers as archives below ``path``; gives the manifest: file, n_records."""

    def save(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])
        sink, file, size, count = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*batch.columns, strict=True):
                page, first = ("" if x.as_py() is None else str(x.as_py()) for x in (page_id, refers))
                for data in records(page, url.as_py(), payload.as_py(), digest.as_py(), first or None, segment_bytes):
                    if sink is None:
                        file = f"{path}/{uuid.uuid4().hex}.warc.gz"
                        fs, place = file_system(file)
                        fs.create_dir(place.rpartition("/")[0], recursive=True)
                        sink, size, count = fs.open_output_stream(place, compression=None), 0, 0
                    sink.write(data)
                    size, count = size + len(data), count + 1
                    if size >= file_bytes:
                        sink.close()
                        sink = None
                        yield pa.RecordBatch.from_pylist([{"file": file, "n_records": count}], schema=schema)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": file, "n_records": count}], schema=schema)

    small_batches(pages.sparkSession)
    return stored(pages.mapInArrow(save, "file string, n_records long"), "archives")


def checked(block: bytes, digest: str, length: int, page: str) -> bytes:
    """The payload of a whole response, held against what its record states."""
    got = payload_of(block)
    if f"sha256:{hashlib.sha256(got).hexdigest()}" != digest or len(got) != length:
        raise Damaged(f"the payload of page {page} isn't the one that its record states")
    return got


def scan(manifest: DataFrame, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """One row for each record. ``data`` is the payload of a whole response (with ``payloads``) or the block of a segment.

    ``origin`` is set for segmented records only, first segments included.
    """

    def load(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]
        rows: list[tuple] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, place = file_system(file)
                with fs.open_input_stream(place, compression=None) as source:
                    for f, data in parse(source):
                        number, kind, digest, page = (f.get(k) for k in ("warc-segment-number", "warc-type", "warc-payload-digest", "x-page-id"))
                        origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if number else None)
                        total, length = (int(f[k]) if k in f else None for k in ("warc-segment-total-length", "x-payload-length"))
                        if origin is None:
                            data = checked(data, digest, length, page) if kind == "response" else None
                            data = data if payloads else None
                        rows.append((kind, origin, int(number) if number else None, total, f.get("warc-target-uri"), page, digest, f.get("x-refers-to-page"), length, data))
                        size += len(data or b"")
                        if size >= READ_BYTES or len(rows) >= 2000:
                            yield out()
                            rows, size = [], 0
        if rows:
            yield out()

    spark = manifest.sparkSession
    return manifest.select("file").repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(load, RECORD)


def whole(found: DataFrame, payloads: bool = True) -> DataFrame:
    """Responses and revisits: what isn't segmented as it is, segments put together by origin, decoded and checked."""

    def join(key, table):
        import pyarrow as pa

        kind = table.column("kind").to_pylist()
        first = [k for k, x in enumerate(kind) if x != "continuation"]
        if len(first) != 1:
            raise Damaged(f"{len(first)} first segments of {key[0].as_py()}")
        (row,) = table.slice(first[0], 1).drop_columns(["data"]).to_pylist()
        block = reassembled([*zip(*(table.column(c).to_pylist() for c in ("segment", "total", "data")), strict=True)], key[0].as_py())
        got = checked(block, row["digest"], row["length"], row["page"]) if row["kind"] == "response" else None
        return pa.Table.from_pylist([row | {"data": got if payloads else None}], schema=table.schema)

    return found.where("origin is null").unionByName(found.where("origin is not null").groupBy("origin").applyInArrow(join, RECORD))


def read_pages(manifest: DataFrame, page_type: str = "long", payloads: bool = True) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record.

    Responses have their payload, if ``payloads`` are asked for; it is held against the length and the digest that the
    record states in any case. Revisits have what their record states. What the scan gives is stored, so that archives
    are read and parsed once; without payloads that is a row of headers for each record, and the segments.
    """
    rows = whole(stored(scan(manifest, payloads), "records"), payloads)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(page_type)
    return rows.select(number("page").alias("page_id"), "url", F.col("data").alias("payload"), F.col("length").alias("payload_bytes"), F.substring_index("digest", ":", -1).alias("payload_digest"), F.col("kind").alias("record_type"), number("refers").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives to shared storage and gives what the archives say about each."""
    kind = pages.schema["page_id"].dataType.simpleString()
    archives = write(with_responses(pages), shared_dir(pages.sparkSession, "warc"))
    return read_pages(archives, kind, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
