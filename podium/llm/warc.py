"""WARC archives with an index (operator 2).

Writing: each task appends its records, one gzip member each, to an archive of
its own and returns an index row per record (archive, offset, length, URL,
digest).  The index is written through Spark's commit protocol, and an archive
is named for the attempt that wrote it, so archives of lost attempts are never
referred to.  Reading: the index rows selected are dealt out by (archive,
offset); neighbouring ranges become one read, cut into records afterwards.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, open_store, scratch_path, task_count

#: an archive is closed once it has so many bytes
ARCHIVE_BYTES = 1 << 30
#: neighbouring ranges are read together across gaps up to MAX_GAP, up to MAX_READ bytes at once
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
#: archive bytes that a task reads: few if there are tasks to spare, else many
TASK_BYTES = 4 << 20, 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, record_type string, key string"
RECORD = ("key string, url string, record_type string, refers_to string, payload binary, "
          "payload_bytes long, payload_digest string")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _head(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    def clean(v):  # a header value has no line breaks
        return re.sub(r"[\r\n]+", " ", v)

    return "\r\n".join([first, *(f"{k}: {clean(v)}" for k, v in fields if v is not None)]).encode() + b"\r\n\r\n"


def _urn(key: str | None) -> str:
    return f"<urn:x-record:{key}>" if key is not None else f"<{uuid.uuid4().urn}>"


def record_bytes(key: str | None, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """One WARC 1.1 record; with ``refers_to`` a revisit, which keeps the HTTP
    head (and so the payload's length) but not the payload."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    revisit = [] if refers_to is None else [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    head = _head("WARC/1.1", [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(key)),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), *revisit,
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block)))])
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's fields; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")

    def key(name):
        m = re.fullmatch(r"<urn:x-record:(.*)>", fields.get(name, ""))
        return m and m[1]

    return {"key": key("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "refers_to": key("WARC-Refers-To"), "payload": payload if kind == "response" else None,
            "payload_bytes": n, "payload_digest": digest}


def _arrow(rows: list[dict] | list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] if isinstance(r, tuple) else r[f.name] for r in rows], f.type) for i, f in enumerate(schema)],
        schema=schema)


_INDEX = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in INDEX.split(", ")])
_RECORD = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
                     for n, t in (x.split() for x in RECORD.split(", "))])


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for key, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "body", "first"))):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    fs, at_path = open_store(folder)
                    fs.create_dir(at_path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at_path}/{name}", compression=None)
                    info = b"software: podium\r\nformat: WARC File Format 1.1\r\n"
                    at += out.write(_gzip_member(_head("WARC/1.1", [
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(None)), ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                        ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
                digest = sha1_base32(payload)
                refers_to = first if first is not None and first != key else None
                member = _gzip_member(record_bytes(key, url, payload, refers_to, digest))
                out.write(member)
                rows.append((name, at, len(member), url, digest, "response" if refers_to is None else "revisit", key))
                at += len(member)
            if rows:
                yield _arrow(rows, _INDEX)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url",
                   payload: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row into archives under ``folder``; the index, one row
    per record, is written beside them and returned.

    ``payload`` is a binary column (default: ``html``; null: empty).  Of the rows
    with equal payloads that of the smallest key is a response, as is any
    repeated row with that key; the others are revisits of it.  Rows with a null
    key are revisits if another row with their payload has a key, else
    responses.  A null URL leaves out the header.  An empty table writes none.
    """
    payload = F.col("html").cast("binary") if payload is None else payload
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"),
                        F.coalesce(payload, F.lit(b"")).alias("body")).withColumn("sha", F.sha1("body"))
    firsts = rows.groupBy(F.col("sha").alias("s")).agg(F.min("k").cast("string").alias("first"))
    # a hot payload is one row on the right; adaptive execution splits it on the left
    typed = rows.join(firsts, F.col("sha") == F.col("s")).select(
        F.col("k").cast("string").alias("key"), "url", "body", "first")
    return materialize(map_batches(typed, _writer(folder, archive_bytes), INDEX)
                       .withColumn("archive", F.concat(F.lit(folder.rstrip("/") + "/"), "archive")), "warc_index")


def _reader(max_gap: int, max_read: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle: list = [None, None]

        def fetch(archive, ranges):
            if handle[0] != archive:
                if handle[1] is not None:
                    handle[1].close()
                fs, path = open_store(archive)
                handle[:] = [archive, fs.open_input_file(path)]
            start = ranges[0][0]
            data = handle[1].read_at(max(o + n for o, n in ranges) - start, start)
            return _arrow([parse_record(zlib.decompress(data[o - start:o - start + n], 31)) for o, n in ranges], _RECORD)

        archive, ranges = None, []
        for batch in batches:
            for a, o, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if ranges and (a != archive or o - sum(ranges[-1]) > max_gap or o + n - ranges[0][0] > max_read):
                    yield fetch(archive, ranges)
                    ranges = []
                archive = a
                ranges.append((o, n))
        if ranges:
            yield fetch(archive, ranges)

    return read


def read_records(index: DataFrame, max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> DataFrame:
    """The records of the index rows given, parsed (see ``RECORD``); a revisit has
    no payload but the length and digest of the one it refers to.  An empty
    index gives no rows."""
    wanted = index.select("archive", "offset", "length")
    # an index row is small, but stands for the bytes it points to
    tasks = task_count(index.sparkSession, wanted.agg(F.sum("length")).first()[0] or 0, *TASK_BYTES)
    dealt = wanted.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return map_batches(dealt, _reader(max_gap, max_read), RECORD)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url",
                       payload: Column | None = None) -> DataFrame:
    """Write archives under the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, key, url, payload))
