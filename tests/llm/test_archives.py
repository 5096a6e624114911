"""Archives: round trips of both versions, SQL, odd pages."""

import gzip
import hashlib
import sys
from pathlib import Path

from corpus import MIDDLE, table

from matchlake.llm import archives
from matchlake.llm.common import Scratch

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from comparison import connect, normal, rows_of_sql  # noqa: E402


def test_equals_sql(spark):
    frame = archives.archived(table(spark, MIDDLE, "pages"))
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == normal(*rows_of_sql(connect(MIDDLE), archives.SQL))


def test_both_versions_are_read():
    payloads = [b"", b"a\n1 2\r\n\r\nb", "grüße   \U0001f600".encode(), b"x" * 5000]
    for version in (1, 2):
        data = archives.arc_head(version, "f.arc") + b"".join(
            archives.arc_record(version, f"http://h/a b{k}", k, p) for k, p in enumerate(payloads)
        )
        records = list(archives.read_arc(data))
        assert [(r.page_id, r.payload) for r in records] == list(enumerate(payloads))
        assert records[1].url == "http://h/a%20b1" and records[1].date == archives.DATE
    assert list(archives.read_arc(archives.arc_record(1, None, None, b"z")))[0].url == "-"


def test_record_fields():
    record = archives.Record("http://h/", "0.0.0.0", "19991231235959", "text/html", 5, b"p" * 200)
    (headers, block), (revisit, head) = archives.read_warc(archives.warc_record(record, None) + archives.warc_record(record, 2))
    assert headers["warc-type"] == "response" and block.endswith(b"p" * 200)
    assert headers["warc-date"] == "1999-12-31T23:59:59Z"
    assert headers["warc-payload-digest"] == f"sha256:{hashlib.sha256(record.payload).hexdigest()}"
    assert revisit["warc-type"] == "revisit" and revisit["x-refers-to-page"] == "2" and b"p" * 200 not in head
    assert headers["warc-record-id"] == list(archives.read_warc(archives.warc_record(record, None)))[0][0]["warc-record-id"]


def test_odd_pages(spark):
    copy, small = "copy " * 30, "tiny"
    pages = [
        (3, "http://a/", copy), (1, "http://b/", copy), (2, None, copy), (4, "", small), (5, " ", small), (6, "u", None), (7, "u", ""),
        (None, "u", copy), (8, "http://x/\n\t y", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (1, "http://b/", copy), (9, "u", "ü" * 3_000_000),
    ]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, digest string, size int")
    found = archives.archived(frame).collect()
    size = lambda h: len((h or "").encode())
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    expected = [
        (i, size(h), digest(h), "revisit" if h == copy and i in (2, 3) else "response", 1 if h == copy and i in (2, 3) else None) for i, _, h in pages
    ]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert archives.archived(frame.where("page_id < 0")).collect() == []


def test_files_are_archives(spark):
    scratch = Scratch(spark, "test-archives")
    archives.write_arc(table(spark, MIDDLE, "pages").repartition(2), scratch)
    archives.convert(scratch)
    files = [gzip.decompress(r[0]) for r in archives._read(scratch, "arc").collect()]
    assert {f.split(b" ", 1)[0] for f in files} == {b"filedesc://pages-1.arc", b"filedesc://pages-2.arc"}
    assert all(f.endswith(b"\n") for f in files)
    for row in archives._read(scratch, "warc").collect():
        data = gzip.decompress(row[0])
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.endswith(b"\r\n\r\n")
