"""WARC archives: writing pages, normalising whole-file gzip streams, and reading records back by offset.

A task writes its rows as one gzip stream (as some crawlers do), which can only be read from its start. The normaliser
inflates such a stream once, in pieces, rewrites each record as a gzip member of its own and writes a sidecar index with
the offset and length of each member; readers then fetch single members. All files go to the shared folder under names
that no other attempt of a task uses, and a table lists those of the attempts that succeeded, so a task may be repeated.
That folder has to be one that pyarrow's file systems open (file, hdfs, s3 or gs). A stream that is cut off is an error, and so
is a number of records other than the number written.

Of rows with equal payloads, those with the smallest id are responses and the others revisit it. A null payload is an empty
one. Rows without an id are always responses, and are never revisited. Repeated rows are each written. An empty table gives
no archive.
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
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, slices, stored

URN = "urn:x-row:"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 20
#: A writer begins another archive after so many bytes of records.
ARCHIVE_BYTES = 1 << 29


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC record; one that refers to another row is a revisit and holds only the HTTP headers."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{URN}{'none' if row_id is None else row_id}"
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(source, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces of bounded size; a member that is cut off is an error."""
    inflate, inside = zlib.decompressobj(31), False
    while data := source.read(piece):
        while data:
            inside = True
            yield inflate.decompress(data, piece)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inside = inflate.unused_data, False
                inflate = zlib.decompressobj(31)
    if inside:
        if rest := inflate.flush():
            yield rest
        if not inflate.eof:
            raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, whole record) of each record of a stream; a stream that ends inside one is an error."""
    held = bytearray()
    for piece in pieces:
        held += piece
        start = 0
        while (end := held.find(b"\r\n\r\n", start)) >= 0:
            head = parsed(bytes(held[start:end]))
            stop = end + 8 + int(head["content-length"])
            if len(held) < stop:
                break
            yield head, bytes(held[start:stop])
            start = stop
        del held[:start]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def member(raw: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def write_archives(pages: DataFrame, folder: str, level: int = 3, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Whole-stream archives of all rows: one row ``(path, n)`` per file.

    Payloads of fewer than ``least`` bytes are never revisits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    narrow = keyed.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    narrow = stored(narrow, "digests")
    # a digest with so many rows that it would stand out in its task (of which there are at most four for each partition) is
    # broadcast, and its rows are dealt out; all others meet their holder by digest
    parts = 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    common = narrow.where(F.col("n") > max(100, total // parts)).select("sha", F.col("holder").alias("common"))
    dealt = keyed.join(F.broadcast(common), "sha", "left").withColumn("salt", F.when(F.col("common").isNotNull(), 1 + F.pmod(F.xxhash64("id", "url"), F.lit(parts))).otherwise(0))
    met = dealt.join(narrow.select("sha", "holder", F.lit(0).cast("long").alias("salt")).hint("merge"), ["sha", "salt"], "left")
    holder = F.coalesce("common", "holder")
    refers = F.when((F.col("id") > holder) & (F.octet_length("payload") >= least), holder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        out = None
        try:
            for batch in slices(batches, 2):
                for row_id, url, payload, holder in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        path, deflate, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                        out = fs.open_output_stream(path, compression=None)
                    raw = record(row_id, url, payload, holder)
                    out.write(deflate.compress(raw))
                    size, n = size + len(raw), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.write(deflate.flush())
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})
            if out is not None:
                out.write(deflate.flush())
                out.close()
                out = None
                yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})
        finally:
            if out is not None:
                out.close()

    return met.select("id", "url", "payload", refers.alias("holder")).mapInArrow(work, "path string, n long")


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Each archive of ``path`` rewritten with one member per record, and its index: ``(path, index, n)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs.create_dir(base, recursive=True)
                new = f"{base}/{uuid.uuid4().hex}.warc.gz"
                at = n = 0
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(new, compression=None) as out, fs.open_output_stream(new + ".idx", compression=None) as index:
                    for head, raw in records(inflated(source)):
                        packed = member(raw, level)
                        out.write(packed)
                        index.write(json.dumps([at, len(packed), head.get("warc-type"), head.get("warc-record-id"), head.get("warc-payload-digest")]).encode() + b"\n")
                        at, n = at + len(packed), n + 1
                yield pa.RecordBatch.from_pydict({"path": [new], "index": [new + ".idx"], "n": [n]})

    return archives.select("path").mapInArrow(work, "path string, index string, n long")


def _row_id(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record, fetched by its offset: ``(id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])``.

    A response's length and digest are taken from its payload, and a digest that differs from the header is an error; a
    revisit's are those its headers state.
    """
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with fs.open_input_file(path) as source, fs.open_input_stream(index, compression=None) as lines:
                    for line in _lines(lines):
                        at, length, *_ = json.loads(line)
                        raw = zlib.decompress(source.read_at(length, at), 31)
                        rows.append(_read(raw, payloads))
                        size += len(raw) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_schema(payloads))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_schema(payloads))

    return archives.select("path", "index").mapInArrow(work, schema)


def _lines(source) -> Iterator[bytes]:
    rest = b""
    while data := source.read(PIECE):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _schema(payloads: bool) -> pa.Schema:
    fields = [("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.schema(fields + [("payload", pa.binary())] * payloads)


def _read(raw: bytes, payloads: bool) -> dict:
    end = raw.index(b"\r\n\r\n")
    head = parsed(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    row = {"id": _row_id(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": _row_id(head.get("warc-refers-to"))}
    if head["warc-type"] == "response":
        payload = block[http_end + 4 :]
        if base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
        row |= {"payload_bytes": len(payload), "payload_digest": digest} | ({"payload": payload} if payloads else {})
    else:
        row |= {"payload_bytes": int(parsed(block[:http_end])["content-length"]), "payload_digest": digest} | ({"payload": None} if payloads else {})
    return row


def round_trip(pages: DataFrame, payloads: bool = False, **columns: str) -> DataFrame:
    """Write, normalise and read back all rows of ``pages``."""
    folder = shared_path(pages.sparkSession, "warc")
    written = stored(write_archives(pages, f"{folder}/streams", **columns), "archives")
    n, rows = written.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(1, n)
    tidy = stored(normalise(written.repartition(n), f"{folder}/members"), "archives")
    if (found := tidy.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) != rows:
        raise ValueError(f"{rows} records were written and {found} found")
    return read_archives(tidy.repartition(n), f"{folder}/members", payloads)
