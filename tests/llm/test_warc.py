"""Archives written and read back: chunks, digests, revisits, damage, edge cases."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import files, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x.org/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(40)]
    rows += [(50, None, "same"), (51, "http://a/\r\nWARC-Type: x", "same"), (52, "http://b", "same"), (60, "u", None)]
    rows += [(None, "n", "same"), (None, "m", "only null"), (7, "http://x.org/7", ""), (61, "é", "é😀" * 30_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(pages, min_bytes=0):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for page_id, body in rows:
        if page_id is not None and len(body) >= min_bytes:
            last[body] = max(page_id, last.get(body, page_id))
    out = []
    for page_id, body in rows:
        first = last.get(body)
        revisit = len(body) >= min_bytes and first is not None and (page_id is None or page_id < first)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,min_bytes", [(1 << 20, 0), (1000, 0), (7, 10)])
def test_records_come_back(pages, size, min_bytes):
    table = pages.where("page_id IS NULL OR page_id != 61") if size < 100 else pages
    manifest = warc.write_archives(warc.chunks(table, min_bytes=min_bytes, chunk_bytes=size), file_bytes=3000)
    assert manifest.count() > 1
    rows = warc.read_archives(manifest, chunk_bytes=size).collect()
    whole = [r for r in rows if r["last"]]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in whole]
    assert sorted(got, key=str) == expected(table, min_bytes)
    for r in rows:
        assert len(r.chunk) <= size and (r["last"] or r.payload_digest is None)
    bodies = {}
    for r in sorted((r for r in rows if r.record_type == "response" and r.page_id), key=lambda r: r.chunk_no):
        bodies.setdefault(r.page_id, hashlib.sha1()).update(r.chunk)
        if r.page_id != 7:
            assert r.digest_so_far == base64.b32encode(bodies[r.page_id].digest()).decode()


def test_files_are_plain_archives_and_headers_hold(pages):
    manifest = warc.write_archives(warc.chunks(pages))
    text = b""
    for row in manifest.collect():
        with files.open_stream(row.path) as stream:
            text += gzip.decompress(stream.read())
    assert text.count(b"WARC/1.1\r\n") == pages.count() == manifest.agg(F.sum("n_records")).first()[0]
    assert b"WARC-Target-URI: http://a/%0D%0AWARC-Type:%20x\r\n" in text
    record = text[text.index(b"WARC-Page-ID: 52\r\n") :]
    head, http, body = record.split(b"\r\n\r\n", 2)
    assert body.startswith(b"same\r\n\r\n") and f"Content-Length: {len(http) + 4 + 4}".encode() in head
    assert f"WARC-Refers-To: {warc.record_id(52)}".encode() in text


def test_damage_is_reported(pages):
    manifest = warc.write_archives(warc.chunks(pages.where("page_id = 52")))
    path = manifest.first().path
    with files.open_stream(path) as stream:
        data = gzip.decompress(stream.read()).replace(b"same", b"sane")
    with files.create(path) as out:
        out.write(gzip.compress(data))
    with pytest.raises(Exception, match="announced digest"):
        warc.read_archives(manifest).collect()


def test_no_pages_and_clashing_columns(pages):
    none = warc.write_archives(warc.chunks(pages.limit(0)))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    more = pages.withColumn("sha1", F.lit("x")).withColumn("first", F.lit(1)).withColumn("payload", F.lit(2))
    assert warc.read_archives(warc.write_archives(warc.chunks(more))).where("last").count() == pages.count()
