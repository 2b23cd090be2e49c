"""WARC archives: writing records as gzip members, and a sequential reader that frames and verifies them.

Archives are real files in a folder that all executors share. A task writes whole files and reports them in a manifest,
which is stored; files of lost attempts are in no manifest. The reader takes one archive per task, decompresses it as it
comes, ends a record by its content length and never holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import stored
from attest.session import shared_folder

DATE = "2020-01-01T00:00:00Z"
FILE_BYTES = 16 << 20
_CHUNK = 1 << 18


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line; line breaks and other control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int) -> bytes:
    """One WARC record as one gzip member."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def _write_files(folder: str, file_bytes: int, level: int):
    def over(batches):
        fs, base = _open_folder(folder)
        fs.create_dir(base, recursive=True)
        out, path, records, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([size])],
                                              names=["path", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "keeper", "revisit")]
            for row in range(batch.num_rows):
                page_id, url, payload, keeper, revisit = (c[row].as_py() for c in columns)
                data = record(page_id, url, payload, keeper, revisit, level)
                if out is not None and size + len(data) > file_bytes:
                    yield closed()
                    out = None
                if out is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            yield closed()

    return over


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Write one record per row to archives in `folder`; returns the stored manifest (path, records, bytes).

    Of records with equal payloads of at least `least_bytes` bytes, that with the largest page id is the response and the
    others revisit it; smaller ones are all responses. A null payload is empty, a null id is below all others, and of
    repeated rows with the largest id every one is a response (so are all rows of a payload that has null ids only).
    Equal payloads meet as one maximum per task and digest. Other columns are not read; an empty table gives no archive.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    keepers = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    judged = rows.join(keepers, "digest", "left").select(
        "page_id", "url", "payload", "keeper",
        (~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("size") >= least_bytes)).alias("revisit"))
    return stored(judged.mapInArrow(_write_files(folder, file_bytes, level), "path string, records long, bytes long"), "warc")


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its decompressed pieces; a member must be read before the next."""
    data = stream.read(_CHUNK)
    while data:
        unpacker = zlib.decompressobj(31)
        rest = b""

        def pieces():
            nonlocal data, rest
            while not unpacker.eof:
                if not data:
                    raise ValueError("an archive ends inside a record")
                piece = unpacker.decompress(data, _CHUNK)
                data = unpacker.unconsumed_tail
                if unpacker.eof:
                    rest = unpacker.unused_data
                elif not data:
                    data = stream.read(_CHUNK)
                if piece:
                    yield piece

        yield pieces()
        if not unpacker.eof:
            raise ValueError("a record was left before its end")
        data = rest or stream.read(_CHUNK)


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; framed by content length, block digest verified."""
    for member in members(stream):
        held = b""
        for piece in member:
            held += piece
            if b"\r\n\r\n" in held:
                break
        head, mark, begun = held.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise ValueError("a gzip member does not start with a WARC header")
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        length = int(fields["content-length"])
        parts, got = [begun], len(begun)
        for piece in member:
            parts.append(piece)
            got += len(piece)
            if got > length + 4:
                raise ValueError("a record is longer than its content length")
        whole = b"".join(parts)
        if len(whole) != length + 4 or not whole.endswith(b"\r\n\r\n"):
            raise ValueError("a record does not end where its content length says")
        block = whole[:length]
        if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest32(block)}":
            raise ValueError(f"block digest of {fields.get('warc-record-id')} differs")
        yield fields, block


def _record_rows(keep_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def parsed(fields, block):
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = fields["warc-type"]
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            if digest32(payload) != digest:
                raise ValueError(f"payload digest of {fields.get('warc-record-id')} differs")
            size = len(payload)
        else:
            size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
        number = lambda name: int(fields[name]) if fields.get(name, "None") != "None" else None
        return {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
                "payload_bytes": size, "payload_digest": digest, "refers_to": number("x-refers-to-page-id"),
                "payload": payload if keep_payload and kind == "response" else None}

    def over(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = _open_folder(path)
                with fs.open_input_stream(place, compression=None) as stream:
                    rows, held = [], 0
                    for fields, block in read_records(stream):
                        rows.append(parsed(fields, block))
                        held += len(block) if keep_payload else 100
                        if held > 1 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return over


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the archives
    whose `path` is in `manifest`; a revisit has no payload of its own. A damaged archive fails the job."""
    files = manifest.select("path")
    spread = files.repartition(max(1, min(10_000, files.count())))
    return spread.mapInArrow(_record_rows(payloads), "page_id long, url string, record_type string, payload_bytes long, "
                                                     "payload_digest string, refers_to long, payload binary")


def archive_folder(spark, name: str = "warc") -> str:
    """A fresh folder for archives below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
