"""WARC archives: writing, normalising monolithic gzip, reading through a sidecar index.

Writing puts a record for each page into archives that are one gzip stream each, as a plain compressor makes them: no
record can be reached without inflating all before it. The normaliser inflates such a stream once, front to back,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets and lengths. Reading seeks to
the members that the index names.

Archives are files in a folder that all executors share, through Arrow's file systems (file, hdfs, s3, gs). An attempt
of a task writes under names of its own, and only the files in a written manifest count, so a lost executor or a second
attempt leaves nothing half-written in the result. Memory is bounded by the largest record.

A target URI keeps what a URI may hold; other characters (white space, controls, all beyond ASCII) are percent-encoded, and
such a record also has its url as it was, as a JSON string in X-URL.

Of records with equal payloads (SHA-1 and length) of at least min_bytes, the one with the smallest page id is a response
and the others are revisits that refer to it; rows that share that page id are all responses. Nulls: a null html is an
empty payload, a null url is left out, rows with a null page id are revisits of their payload's smallest id, or responses
if there is none. Empty tables give empty archives and results; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import map_arrow, slices
from quillrank.runtime import materialise, shared_dir

READ_BYTES, LEVEL, ROTATE_BYTES = 1 << 20, 3, 1 << 30
#: Fixed values of the format.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_length = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A WARC record; first: the page whose equal payload it refers to, or None for a response."""
    head = HTTP_HEAD % len(payload)
    block = head if first is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        uri = quote(url, safe=":/?#[]@!$&()*+,;=%~-._" + chr(39))
        lines += [f"WARC-Target-URI: {uri}"] + ([f"X-URL: {json.dumps(url)}"] if uri != url else [])
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>", f"X-Refers-To-Page-ID: {first}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def inflated(read, size: int = READ_BYTES) -> Iterator[bytes]:
    """Bytes of a gzip file of one or many members. A file that ends within a member raises an error."""
    z, fresh = zlib.decompressobj(31), True
    while data := read(size):
        while data:
            yield z.decompress(data)
            fresh = False
            data = z.unused_data
            if z.eof:
                z, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("the gzip stream is cut off")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of bytes."""
    buffer, at = bytearray(), 0
    for chunk in chunks:
        buffer += chunk
        while True:
            end = buffer.find(b"\r\n\r\n", at)
            if end < 0:
                break
            m = _length.search(buffer, at, end)
            if m is None:
                raise ValueError("a record has no Content-Length")
            stop = end + 4 + int(m[1]) + 4
            if len(buffer) < stop:
                break
            yield bytes(buffer[at:stop])
            at = stop
        if at:
            del buffer[:at]
            at = 0
    if buffer:
        raise ValueError("the last record is cut off")


def parsed(rec: bytes) -> dict:
    """Type, url and ids of a record, the length and digest of its payload; a response's are those of what it holds."""
    head, _, block = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "response":
        payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        size, digest = len(payload), base32_sha1(payload)
        if digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload doesn't match its digest")
    else:
        payload, size, digest = None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": json.loads(fields["X-URL"]) if "X-URL" in fields else fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def with_first(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """id, url, html and first: the page that a revisit refers to, else null. Copies are counted per digest before the
    pages meet them; only digests with several rows are joined."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = own.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("id").alias("least"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "size", "least")
    joined = own.join(groups, ["sha", "size"], "left")
    return joined.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of with_first() as monolithic archives in folder; the manifest (path, records) of what was written."""

    def run(batches):
        out, z, count, size, path = None, None, 0, 0, None

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

        fs, base = file_system(folder)
        for batch in batches:
            for part in slices(batch, 2):
                for i, u, h, f in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None:
                        name = f"mono-{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(base, recursive=True)
                        out, z, count, size, path = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0, f"{folder}/{name}"
                    rec = record(i, u, h.encode(), f)
                    out.write(z.compress(rec))
                    count, size = count + 1, size + len(rec)
                    if size >= ROTATE_BYTES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return materialise(map_arrow(rows, run, "path string, records bigint"), "warc-manifest")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of the manifest with one gzip member a record, beside a sidecar index of JSON lines (offset,
    length, page_id, record_type); the manifest (path, index_path, records) of the new archives."""

    def run(batches):
        fs, base = file_system(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"members-{uuid.uuid4().hex}"
                src, at = file_system(source)
                offset, count = 0, 0
                fs.create_dir(base, recursive=True)
                with src.open_input_stream(at, compression=None) as f, fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{base}/{name}.index.jsonl", compression=None) as index:
                    for rec in records(inflated(f.read)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        out.write(member)
                        kind = re.search(rb"\r\nWARC-Type: (\w+)", rec)[1].decode()
                        page = re.search(rb"\r\nX-Page-ID: (-?\d+)", rec[: rec.index(b"\r\n\r\n")])
                        index.write(json.dumps({"offset": offset, "length": len(member), "page_id": int(page[1]) if page else None, "record_type": kind}).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "index_path": [f"{folder}/{name}.index.jsonl"], "records": pa.array([count], pa.int64())})

    files = max(1, manifest.count())
    return materialise(map_arrow(manifest.select("path").repartition(files), run, "path string, index_path string, records bigint"), "warc-index")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of normalised archives, each read through the index: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with payloads the payload itself (null for revisits)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches):
        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (fs, at), (fs2, index_at) = file_system(path), file_system(index_path)
                with fs.open_input_file(at) as f, fs2.open_input_stream(index_at, compression=None) as index:
                    rows, size = [], 0
                    for line in index.read().splitlines():
                        x = json.loads(line)
                        rows.append(parsed(zlib.decompress(f.read_at(x["length"], x["offset"]), 31)))
                        size += x["length"]
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    files = max(1, manifest.count())
    return map_arrow(manifest.select("path", "index_path").repartition(files), run, ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def round_trip(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder, normalises them and reads them back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = write_archives(with_first(pages, id_col, url_col, html_col, min_bytes), folder)
    return read_archives(normalise(written, folder))
