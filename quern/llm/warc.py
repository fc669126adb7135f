"""Legacy archive converter: ARC records to equivalent WARC records.

ARC files start with a version block whose first line declares the version and whose second names the
fields of every record line: version 1 has URL, IP address, date, type and length; version 2 adds result
code, checksum, location, offset and file name before the length. Records follow, each a line and as many
bytes as it declares. The converter reads them by those declarations and writes WARC/1.1 records with
synthesised identifiers, ISO dates, types and SHA-256 payload digests; of equal payloads of at least 100
bytes the one with the smallest page id stays a response, the others become revisits that refer to it.

Archives are rows of a table (one binary column), so that they live in whatever store Spark uses.

Defined results: null pages have an empty payload; a null URL becomes ``urn:none``; white space and control
characters in URLs are percent-encoded; a null page id is never referred to and its copies are responses
unless an equal payload has an id; rows that repeat id and payload are alike; pages of one id and several payloads
are apart by these; an empty table gives an empty table; columns of the input other than page_id, url and html
are not read, so that none can clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import slices
from quern.llm.common import checkpointed

#: Payloads of fewer bytes are never revisits.
LEAST = 100
ARCHIVE_BYTES = 4 << 20
#: Bytes of an archive that the reader takes at a time.
_WINDOW = 1 << 14
#: Field names of the record lines by ARC version, fixed by the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _http(page_id: int | None, size: int) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (size, own)


def arc_bytes(pages: list[tuple[int | None, str | None, bytes]], version: int, date: str, name: str) -> bytes:
    body = f"{version} 0 quern\n{ARC_FIELDS[version]}\n\n".encode()
    more = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode(), body]
    at = len(out[0]) + len(body)
    for page_id, url, html in pages:
        block = _http(page_id, len(html)) + html
        link = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
        more = "" if version == 1 else f" 200 - - {at} {name}"
        line = f"\n{link} 0.0.0.0 {date} text/html{more} {len(block)}\n".encode("utf-8", "surrogatepass")
        out += [line, block]
        at += len(line) + len(block)
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line by lower-case name, content) of every record after the version block."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    version, names = data[end + 1 : end + 1 + length].split(b"\n")[:2]
    fields = names.decode().lower().split(" ")
    if version.split(b" ")[0] not in (b"1", b"2") or len(fields) not in (5, 10):
        raise ValueError(f"not an ARC version block: {version!r}")
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields where the version block names {len(fields)}")
        record = dict(zip(fields, parts, strict=True))
        size = int(record["archive-length"])
        if end + 1 + size > len(data):
            raise ValueError("a record declares more bytes than there are")
        yield record, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.lower(): v for k, v in pairs}, payload


def record_id(page_id: int | None, digest: str) -> str:
    """The same URN for the same page and payload, wherever it is made."""
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def warc_record(url: str, date: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    block = _http(page_id, len(payload)) + (b"" if revisit else payload)
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Target-URI: {url}", f"WARC-Date: {stamp}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    return head + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a file of gzip members, read by windows, so that
    no record copies what follows it."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("a record is cut short")
            window = view[at : at + _WINDOW]
            parts.append(member.decompress(window))
            at += len(window) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        yield fields, rest[: int(fields["content-length"])]


def _gzip(data: bytes) -> bytes:
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


def write_arc(pages: DataFrame, version: int = 1, date: str = "20240101000000") -> DataFrame:
    """One row (archive) for each run of pages of about four megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, htmls = (c.to_pylist() for c in batch.columns)
            htmls = [(h or "").encode("utf-8", "surrogatepass") for h in htmls]
            for lo, hi in slices([len(h) + 200 for h in htmls], ARCHIVE_BYTES):
                made = arc_bytes(list(zip(ids[lo:hi], urls[lo:hi], htmls[lo:hi], strict=True)), version, date, "pages.arc")
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["archive"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "archive binary")


def read_arc(archives: DataFrame) -> DataFrame:
    """url, date, page_id, payload, digest, size of every record of the ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for record, block in arc_records(archive.as_py()):
                    http, payload = split_http(block)
                    rows.append((record["url"], record["archive-date"], int(http["x-page-id"]) if "x-page-id" in http else None, payload, hashlib.sha256(payload).hexdigest(), len(payload)))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())
                names = ["url", "date", "page_id", "payload", "digest", "size"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return archives.mapInArrow(run, "url string, date string, page_id long, payload binary, digest string, size long")


def convert(arc: DataFrame) -> DataFrame:
    """WARC files (archive) with a response or revisit for each ARC record.

    Only digests that occur again are joined to the records; a payload of very many copies makes a skewed
    key on the side that adaptive execution splits.
    """
    records = read_arc(arc)
    again = records.where(f"size >= {LEAST}").groupBy("digest").agg(F.min("page_id").alias("kept"), F.count("*").alias("c")).where("c > 1 and kept is not null").drop("c")
    joined = records.join(again, "digest", "left").select("url", "date", "page_id", "payload", "digest", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for url, date, page_id, payload, digest, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_gzip(warc_record(url, date, page_id, payload, digest, kept, kept is not None and kept != page_id)))
                size += len(held[-1])
                if size > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    return joined.mapInArrow(run, "archive binary")


def read_warc(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """record_id, record_type, page_id, payload_bytes, payload_digest, refers_to_id of every WARC record.

    The digest of a response is computed anew from its payload and must equal the declared one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "url", *["payload"] * payloads]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for fields, block in warc_records(archive.as_py()):
                    http, payload = split_http(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']} does not have the payload that it declares")
                    row = (fields["warc-record-id"], fields["warc-type"], int(http["x-page-id"]) if "x-page-id" in http else None, int(http["content-length"]), digest, fields.get("warc-refers-to"), fields["warc-target-uri"])
                    rows.append((*row, payload) if payloads else row)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    more = ", payload binary" if payloads else ""
    return archives.mapInArrow(run, f"record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, url string{more}")


def archived(pages: DataFrame, version: int = 1) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the WARC files."""
    stored = checkpointed(convert(write_arc(pages, version)))
    records = checkpointed(read_warc(stored))
    kept = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    return records.join(kept, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same result in DuckDB SQL.
SQL = """
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> least THEN least END AS refers_to
FROM (SELECT page_id, size, digest, min(page_id) OVER (PARTITION BY digest) AS least
      FROM (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages))
"""
