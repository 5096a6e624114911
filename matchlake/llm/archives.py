"""Legacy archives: pages written as ARC, converted to WARC, and read back.

ARC files begin with a version block whose header line has the fields of version 1 or 2; every
record is a header line with a declared length, that many bytes, and a line end. The
converter reads files of either version by their declared lengths and synthesises what WARC asks
for: record identifiers, ISO timestamps, types and digests. Files are written with
Spark's text writer, one bounded file a row, so any storage that Spark knows can hold them.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of records after which a file ends.
FILE_BYTES = 4_000_000
#: Payloads smaller than this are never stored as revisits.
LEAST_REVISIT = 100
#: Field lists of the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ADDRESS, DATE, MIME = "0.0.0.0", "20000101000000", "text/html"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class Record:
    """An archived response."""

    url: str
    address: str
    date: str
    mime: str
    page_id: int | None
    payload: bytes


def _http(page_id: int | None, length: int) -> bytes:
    named = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {length}\r\n\r\n".encode()


def _field(value: str | None) -> str:
    """A header field without white space; what is missing is a dash."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._") if value and value.strip() else "-"


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes) -> bytes:
    body = _http(page_id, len(payload)) + payload
    fields = [_field(url), ADDRESS, DATE, MIME]
    if version == 2:
        fields += ["200", hashlib.md5(body).hexdigest(), "-", "0", "-"]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_head(version: int, name: str) -> bytes:
    """The version block that begins a file."""
    block = f"{version} 0 matchlake\n{FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", ADDRESS, DATE, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def _split_http(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def read_arc(data: bytes) -> Iterator[Record]:
    """Records of a file; the version block says which fields header lines have."""
    at, fields = 0, FIELDS[1].split()
    while at < len(data):
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8").split(" ")
        length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        at = end + 1 + length + 1
        if parts[0].startswith("filedesc:"):
            fields = body.decode("utf-8").split("\n")[1].split(" ")
            continue
        values = dict(zip(fields, parts, strict=True))
        headers, payload = _split_http(body)
        page_id = headers.get("x-page-id")
        yield Record(
            values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"],
            None if page_id is None else int(page_id), payload,
        )


def _identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(map(str, parts)))}>"


def _timestamp(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    fields = b"software: matchlake\r\nformat: WARC File Format 1.1\r\n"
    return _warc([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", _identifier("info", name)), ("WARC-Date", _timestamp(DATE)),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ], fields)


def warc_record(record: Record, refers_to: int | None) -> bytes:
    """The record as a response, or as a revisit of another page's response."""
    digest = hashlib.sha256(record.payload).hexdigest()
    revisit = refers_to is not None
    block = _http(record.page_id, len(record.payload)) + (b"" if revisit else record.payload)
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _identifier(record.page_id, digest)),
        ("WARC-Date", _timestamp(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.address),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _identifier(refers_to, digest)),
            ("X-Refers-To-Page", refers_to),
        ]
    return _warc(headers, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = stop + 4


def _files(parts: Iterable[bytes], head: bytes, tail: int) -> Iterator[pa.RecordBatch]:
    """Rows of one bounded file each; the writer adds the last record's line end of ``tail`` bytes."""
    held, size = [head], 0

    def out() -> pa.RecordBatch:
        text = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([text[: len(text) - tail]]).cast(pa.string())], ["value"])

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= FILE_BYTES:
            yield out()
            held, size = [head], 0
    if len(held) > 1:
        yield out()


def _write(files: DataFrame, path: str, line_end: str) -> None:
    files.write.mode("overwrite").option("lineSep", line_end).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _read(scratch: Scratch, name: str) -> DataFrame:
    return scratch.spark.read.format("binaryFile").load(scratch.path(name)).select("content")


def write_arc(pages: DataFrame, scratch: Scratch) -> None:
    """Pages as ARC files; a task's files are of version 1 or 2 by turns of its partition."""
    rows = pages.select(
        F.col("`page_id`").cast("bigint").alias("page_id"),
        F.col("`url`").cast("string").alias("url"),
        F.coalesce(F.col("`html`").cast("string"), F.lit("")).alias("html"),
        (F.spark_partition_id() % 2 + 1).alias("version"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            version = batch.column(3)[0].as_py()
            html = batch.column(2).cast(pa.binary()).to_pylist()
            records = (arc_record(version, u, i, h) for i, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, strict=True))
            yield from _files(records, arc_head(version, f"pages-{version}.arc"), 1)

    _write(rows.mapInArrow(run, "value string"), scratch.path("arc"), "\n")


def _arc_rows(scratch: Scratch) -> DataFrame:
    """Records of the ARC files, their payloads' sizes and digests."""
    names = ["page_id", "url", "address", "date", "mime", "payload", "digest", "size"]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [
                    (r.page_id, r.url, r.address, r.date, r.mime, r.payload, hashlib.sha256(r.payload).hexdigest(), len(r.payload))
                    for r in read_arc(gzip.decompress(content.as_py()))
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _read(scratch, "arc").mapInArrow(
        run, "page_id bigint, url string, address string, date string, mime string, payload binary, digest string, size bigint"
    )


def convert(scratch: Scratch) -> None:
    """The ARC files as WARC files, equal payloads stored once.

    Of records with one digest the smallest id is the response. Only digests are
    grouped, and those that several records share are joined back.
    """
    records = _arc_rows(scratch)
    shared = (
        records.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    )
    shared = scratch.write(shared, "shared")
    joined = records.join(shared, "digest", "left")
    revisit = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    rows = joined.select("page_id", "url", "address", "date", "mime", "payload", revisit.alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            records = (
                warc_record(Record(u, a, d, m, i, p), r) for i, u, a, d, m, p, r in zip(*columns, strict=True)
            )
            yield from _files(records, warc_info("pages.warc"), 4)

    _write(rows.mapInArrow(run, "value string"), scratch.path("warc"), "\r\n\r\n")


def read_back(scratch: Scratch) -> DataFrame:
    """A row for each record of the WARC files but their information records."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_warc(gzip.decompress(content.as_py())):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    if hashlib.sha256(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
                        raise ValueError(f"damaged record {headers['warc-record-id']}")
                    http, payload = _split_http(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload {headers['warc-record-id']}")
                    page_id, other = http.get("x-page-id"), headers.get("x-refers-to-page")
                    size = int(http["content-length"]) if revisit else len(payload)
                    rows.append((page_id and int(page_id), size, digest, headers["warc-type"], other and int(other)))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _read(scratch, "warc").mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )


def archived(pages: DataFrame) -> DataFrame:
    """What the archives hold of each row of ``pages``.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest`` (SHA-256), ``record_type`` and
    ``refers_to``. A null html is an empty payload, a null url a dash; a row without an id
    is always a response; repeated rows of one id are all responses or all revisits. Other
    columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "archives")
    write_arc(pages, scratch)
    convert(scratch)
    scratch.drop("arc")
    return read_back(scratch)


#: The same rows as SQL.
SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages
), s AS (
    SELECT payload_digest, min(page_id) AS first FROM p WHERE octet_length(payload) >= 100 GROUP BY ALL
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN s ON s.payload_digest = p.payload_digest AND octet_length(p.payload) >= 100
"""
