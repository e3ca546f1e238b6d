"""WARC archives: written by Spark tasks, read back by a sequential reader.

Every record is a gzip member of its own. The reader takes an archive as a stream: it inflates a piece at a time, frames
the record by its Content-Length, and compares digests. Archives go to the shared folder through its file system; a
task names its files anew on each attempt, and only files that finished tasks have listed are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from herdsignal.llm import common as C
from herdsignal.session import cut, fresh_path

#: Bytes per archive after which a task begins the next one; bytes read at a time; compression level.
ARCHIVE_BYTES, READ_BYTES, LEVEL = 64 << 20, 1 << 18, 4
#: Most bytes that a record's header may have before it is taken for damage.
HEADER_BYTES = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))


def digest(data: bytes) -> str:
    """Base32 SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page ``refers_to`` with the same payload."""
    http = _http(len(payload))
    block = http if refers_to is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}".encode()]
    lines.append(f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>".encode())
    if url is not None:
        lines.append(b"WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~").encode())
    lines += [f"WARC-Date: {date}".encode(), b"Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}".encode(), f"WARC-Payload-Digest: sha1:{digest(payload)}".encode()]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>".encode(), f"WARC-Profile: {PROFILE}".encode()]
    lines.append(f"Content-Length: {len(block)}".encode())
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(lines) + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        name, out, size, records, done = "", None, 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, payload, refers_to = (v.as_py() for v in row)
                data = record(page_id, url, payload, refers_to, date)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], ["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the list of archives (path, records, bytes), itself a written table.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others
    revisit it; rows with smaller payloads, and rows without an id, are responses. Null payloads are empty. Rows that
    repeat the smallest id are all responses; rows that repeat an id with another payload are told apart by it. Only the three named columns are read.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = C.only(pages, id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("id", F.col("id").cast("long"))
    # Two digests and the length stand for the payload.
    key = F.concat_ws(":", F.sha1("payload"), F.md5("payload"), F.length("payload").cast("string"))
    rows = rows.withColumn("key", F.when((F.length("payload") >= least) & F.col("id").isNotNull(), key))
    keyed = cut(rows.where("key IS NOT NULL").select("id", "key"), "payloads")
    groups = cut(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    revisits = C.hot_join(keyed, groups, "key", "n").where("first < id").select("id", "key", "first").distinct()
    joined = rows.join(revisits, ["id", "key"], "left").select("id", "url", "payload", "first")
    return cut(joined.mapInArrow(_write(folder, date), "path string, records long, bytes long"), "archives")


class Damaged(ValueError):
    """An archive that breaks the format."""


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream: its content, piece by piece."""
    held = stream.read(READ_BYTES)

    def content() -> Iterator[bytes]:
        nonlocal held
        inflate = zlib.decompressobj(31)
        while True:
            piece = inflate.decompress(held, READ_BYTES)
            held = inflate.unconsumed_tail
            if piece:
                yield piece
            if inflate.eof:
                held = inflate.unused_data
                return
            if not held:
                held = stream.read(READ_BYTES)
                if not held:
                    raise Damaged("the archive ends within a record")

    while True:
        if not held:
            held = stream.read(READ_BYTES)
        if not held:
            return
        yield content()


def parse(pieces: Iterator[bytes]) -> dict:
    """A record's headers, block and payload digests, framed by its Content-Length."""
    head = b""
    for piece in pieces:
        head += piece
        if b"\r\n\r\n" in head:
            break
        if len(head) > HEADER_BYTES:
            raise Damaged("a header without an end")
    else:
        raise Damaged("a record without a header")
    head, _, rest = head.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise Damaged("no WARC record")
    headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines)}
    size = int(headers["content-length"])
    block = [rest]
    held = len(rest)
    for piece in pieces:
        block.append(piece)
        held += len(piece)
    data = b"".join(block)
    if held != size + 4 or data[size:] != b"\r\n\r\n":
        raise Damaged("the content does not have the length that its header gives")
    data = data[:size]
    http, _, payload = data.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    given = {k: headers.get(f"warc-{k}-digest", "").removeprefix("sha1:") for k in ("block", "payload")}
    revisit = headers["warc-type"] == "revisit"
    good = given["block"] == digest(data) and (revisit or given["payload"] == digest(payload))

    def page(name: str) -> int | None:
        number = headers.get(name, "").strip("<>").removeprefix(RECORD_ID)
        return int(number) if number else None

    return {
        "id": page("warc-record-id"),
        "url": headers.get("warc-target-uri"),
        "record_type": headers["warc-type"],
        "payload_bytes": int(stated[1]) if revisit and stated else len(payload),
        "payload_digest": given["payload"] if revisit else digest(payload),
        "refers_to": page("warc-refers-to"),
        "digest_ok": good,
        "payload": None if revisit else payload,
    }


_RECORDS = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, payload binary"


def _read(payloads: bool):
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in _RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = filesystem(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for member in members(stream):
                        row = parse(member)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += 512 + len(row["payload"] or b"")
                        if held >= C.STEP_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives (path): id, url, record_type, payload_bytes, payload_digest, refers_to,
    digest_ok, payload (null for revisits, or if not asked for).

    Size and digest are those of the full payload, for a revisit as its headers give them. ``digest_ok`` is false
    where the content does not have the digests of its header; an archive that breaks the format ends the job. Archives
    are dealt one by one; a record is in memory, an archive is not.
    """
    dealt = archives.select("path").repartition(C.tasks(archives), "path")
    return dealt.mapInArrow(_read(payloads), _RECORDS)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages as archives and reads them back without payloads; the id has its own name again."""
    return read(write(pages, folder, id_col, url_col, payload_col, least), payloads=False).withColumnRenamed("id", id_col)
