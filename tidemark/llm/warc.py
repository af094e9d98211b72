"""WARC archives through a table of chunks.

``chunks`` turns pages into rows of (record, chunk number, bytes), so that an oversized payload moves in
pieces. ``write_archives`` takes those rows as a stream, one gzip member a record, and rolls over to
a new file at ``file_bytes``; ``read_archives`` streams the members back as chunk rows. Both carry the
SHA-1 of a payload from chunk to chunk: the writer refuses a payload that is not the one its header
announces, the reader reports the digest so far in each row and the digest of the whole in the last.

Equal payloads of at least ``min_bytes`` are stored once: the largest page id is the response, the others
are revisit records that name it.

Edge cases: a missing payload is the empty one. A missing page id counts as smaller than any other;
where all of a group are missing, all are responses. Rows that repeat a page id with an equal payload
are written alike, each as a record of its own with the same record id. Control characters of a URL
are escaped, a missing URL has no header line. Further columns are not archived. No pages, no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

CHUNK_BYTES = 1 << 20
FILE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"

CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, sha1 string, "
    "chunk_no long, last boolean, chunk binary"
)
READ = (
    "page_id long, url string, record_type string, refers_to long, record_id string, chunk_no long, "
    "chunk binary, bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"
)


def chunks(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Chunk rows of all pages with the record type; a record's chunks follow one another."""
    body = F.col(body_col)
    if dict(pages.dtypes)[body_col] == "string":
        body = F.encode(body, "UTF-8")
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(body, F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    # narrow: the payload is read for its digest and not moved
    shared = (
        keyed.where(F.length("payload") >= min_bytes).groupBy(F.col("sha1").alias("same"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    )
    revisit = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") < F.col("first"), F.lit(True)))
    size = F.length("payload")
    n = F.greatest(F.ceil(size / chunk_bytes).cast("int"), F.lit(1))
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(
            k.cast("long").alias("chunk_no"), (k == n - 1).alias("last"),
            F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"),
        ),
    )
    none = F.array(F.struct(F.lit(0).cast("long").alias("chunk_no"), F.lit(True).alias("last"), F.lit(b"").alias("chunk")))
    return (
        keyed.join(shared, keyed.sha1 == shared.same, "left")
        .select(
            "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.when(revisit, F.col("first")).alias("refers_to"), size.cast("long").alias("payload_bytes"), "sha1",
            F.explode(F.when(revisit, none).otherwise(pieces)).alias("c"),
        )
        .select("page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "c.*")
    )


def record_id(page_id: int | None) -> str:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}") if page_id is not None else uuid.uuid4()
    return f"<urn:uuid:{name}>"


def _header(row: dict) -> tuple[bytes, bytes]:
    """Lines of a record before its block, and the HTTP head that opens the block."""
    revisit = row["record_type"] == "revisit"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}"]
    lines.append(f"WARC-Date: {DATE}")
    if row["url"] is not None:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        lines.append(f"WARC-Target-URI: {url}")
    if row["page_id"] is not None:
        lines.append(f"WARC-Page-ID: {row['page_id']}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(row['refers_to'])}")
        lines.append(f"WARC-Refers-To-Page-ID: {row['refers_to']}")
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {row['payload_bytes']}"]
    lines.append("Content-Type: application/http;msgtype=response")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http.encode()


def write_archives(chunk_rows: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows as ``.warc.gz`` files; the manifest (path string, n_records long, n_bytes long)."""
    target = files.folder_for(chunk_rows.sparkSession, "warc", folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n_records, n_bytes, number = None, "", 0, 0, 0
        zipped, digest, sha1 = None, None, ""
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append({"path": path, "n_records": n_records, "n_bytes": n_bytes})
                out = None

        def put(data: bytes):
            nonlocal n_bytes
            out.write(data)
            n_bytes += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and n_bytes >= file_bytes:
                        close()
                    if out is None:
                        path = files.part_name(target, number, ".warc.gz")
                        out, number, n_records, n_bytes = files.create(path), number + 1, 0, 0
                    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                    digest = hashlib.sha1() if row["record_type"] == "response" else None
                    head, http = _header(row)
                    put(zipped.compress(head + http))
                    n_records += 1
                    sha1 = row["sha1"]
                if digest is not None:
                    digest.update(row["chunk"])
                    put(zipped.compress(row["chunk"]))
                if row["last"]:
                    if digest is not None and digest.hexdigest() != sha1:
                        raise ValueError(f"payload of page {row['page_id']} is not the one announced")
                    put(zipped.compress(b"\r\n\r\n") + zipped.flush())
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    manifest = chunk_rows.mapInArrow(write, "path string, n_records long, n_bytes long")
    return files.written(manifest, "warc-manifest")


class _Member:
    """Bytes of one gzip member after another, decompressed block by block."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.raw, self.held, self.zip = stream, block, b"", b"", None

    def next_record(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.block)
        self.zip, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _more(self) -> bool:
        if self.zip.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(self.block)
            if not self.raw:
                raise ValueError("archive ends inside a record")
        self.held += self.zip.decompress(self.raw, self.block)
        self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.held:
            if not self._more():
                raise ValueError("record without a header")
        head, self.held = self.held.split(mark, 1)
        return head

    def take(self, most: int) -> bytes:
        while len(self.held) < most and self._more():
            pass
        data, self.held = self.held[:most], self.held[most:]
        return data

    def finish(self) -> None:
        while self._more():
            self.held = b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _records(path: str, chunk_bytes: int) -> Iterator[dict]:
    with files.open_stream(path) as stream:
        member = _Member(stream, 256 << 10)
        while member.next_record():
            head = _fields(member.until(b"\r\n\r\n"))
            http = member.until(b"\r\n\r\n")
            left = int(head["content-length"]) - len(http) - 4
            number = lambda key: int(head[key]) if key in head else None
            base = {
                "page_id": number("warc-page-id"), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
                "refers_to": number("warc-refers-to-page-id"), "record_id": head["warc-record-id"].strip("<>"),
            }
            announced, size = head["warc-payload-digest"].removeprefix("sha1:"), number("warc-payload-length")
            digest, so_far, k = hashlib.sha1(), 0, 0
            while True:
                data = member.take(min(chunk_bytes, left))
                left -= len(data)
                if left and not data:
                    raise ValueError(f"{base['record_id']} is cut short")
                digest.update(data)
                so_far += len(data)
                last = not left
                now = base64.b32encode(digest.digest()).decode()
                if last and base["record_type"] == "response" and (now, so_far) != (announced, size):
                    raise ValueError(f"{base['record_id']} does not have the announced digest")
                whole = {"payload_bytes": size, "payload_digest": announced} if last else {}
                yield base | {
                    "chunk_no": k, "chunk": data, "bytes_so_far": so_far, "digest_so_far": now, "last": last,
                    "payload_bytes": None, "payload_digest": None,
                } | whole
                k += 1
                if last:
                    break
            member.finish()


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives in a manifest; ``payload_*`` stand in the last row of a record.

    A revisit has one empty chunk, and the length and digest of the payload that it stands for.
    """
    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("record_id", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in _records(path, chunk_bytes):
                    size += len(row["chunk"])
                    rows.append(row if with_data else row | {"chunk": None})
                    if size >= 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.one_file_a_task(manifest.select("path")).mapInArrow(read, READ)
