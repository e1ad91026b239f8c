"""WARC archives: writing, a normaliser for monolithic gzip, and reading by a sidecar index.

A monolithic archive is one gzip stream over the whole file, which allows no access to single records. The
normaliser inflates that stream once, rewrites every record as a gzip member of its own, and writes a sidecar
with each member's offset and length. Files are written under a name of the attempt's own and then renamed,
so a task that is run again, because an executor was lost, leaves the same files.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, batch

CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = pa.schema([("name", pa.string())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])


class Store:
    """Files below a folder: local and shared file systems by path, any other address through pyarrow's file systems."""

    def __init__(self, root: str):
        self.fs, self.root = None, root.removeprefix("file://")
        if "://" in self.root:
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(root)

    @contextlib.contextmanager
    def create(self, name: str) -> Iterator[BinaryIO]:
        """A file that appears under its name only once it is whole."""
        path, part = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.fs:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(part) as f:
                yield f
            self.fs.move(part, path)
        else:
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                yield f
            os.replace(part, path)

    def open(self, name: str) -> BinaryIO:
        return self.fs.open_input_file(f"{self.root}/{name}") if self.fs else open(f"{self.root}/{name}", "rb")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, page_id: int | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries its payload's digest and size but no payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:feedloom:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if uri:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:feedloom:page:{refers_to}>", f"WARC-Payload-Length: {size}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers_of(data: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in data.decode().split("\r\n")[1:])}


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one member or several, in chunks of bounded size however well they are compressed."""
    stream = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while True:
            out = stream.decompress(data, CHUNK)
            yield out
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
                if not data:
                    break
            else:
                data = stream.unconsumed_tail
                if not data and len(out) < CHUNK:
                    break


def records_in(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, cut by their Content-Length; one record at a time is in memory."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while True:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            whole = end + 4 + int(headers_of(bytes(held[:end]))["content-length"]) + 4
            if len(held) < whole:
                break
            yield bytes(held[:whole])
            del held[:whole]
    if held:
        raise ValueError("the archive ends within a record")


def normalise(store: Store, source: str, target: str) -> int:
    """Rewrites an archive with a gzip member for each record and target.idx with 'offset length record-id' lines."""
    at, lines = 0, io.StringIO()
    with store.open(source) as f, store.create(target) as out:
        for whole in records_in(inflated(f)):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(whole) + packer.flush()
            out.write(member)
            lines.write(f"{at} {len(member)} {headers_of(whole[: whole.find(b'\r\n\r\n')])['warc-record-id']}\n")
            at += len(member)
    with store.create(f"{target}.idx") as out:
        out.write(lines.getvalue().encode())
    return at


def read_member(f: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    f.seek(offset)
    whole = zlib.decompress(f.read(length), 31)
    end = whole.find(b"\r\n\r\n")
    headers = headers_of(whole[:end])
    body = whole[end + 4 : end + 4 + int(headers["content-length"])]
    return headers, body[body.find(b"\r\n\r\n") + 4 :]


def page_in(name: str) -> int | None:
    inside = name.rpartition(":")[2].rstrip(">")
    return int(inside) if inside else None


def archive_pages(pages: DataFrame, min_bytes: int = 0, pages_an_archive: int = 2000, folder: str | None = None) -> DataFrame:
    """Writes every page to WARC archives, normalises them, and reads them back by their sidecars.

    Among records with equal payloads of at least ``min_bytes`` bytes, those with the smallest page_id are
    responses and all others revisit that page_id (rows that repeat the smallest page_id are all responses); null ids sort last and
    are responses where no other page has their payload. A null html is an empty payload, and html may be of any length (a
    record is held whole). An empty table gives no rows; further columns aren't read. Returns page_id, payload_bytes, payload_digest,
    record_type and refers_to as read back, with the record's archive and offset. Archives lie in ``folder`` (a
    shared folder of this call's own by default): N.mono.warc.gz, N.warc.gz and N.warc.gz.idx.
    """
    spark = pages.sparkSession
    root = folder or Workspace(spark, "warc").root

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows come ordered by archive; each archive is one gzip stream.

        Of a payload that several pages have, a row without a record comes before a page's own and names the first page.
        """
        store, current, out, packer = Store(root), None, None, None
        told, said = None, None
        stack = contextlib.ExitStack()

        def close() -> None:
            if current is not None:
                out.write(packer.flush())
                stack.close()

        for rows in batches:
            names = []
            columns = [rows.column(x).to_pylist() for x in ("archive", "page_id", "url", "digest", "payload", "first")]
            for archive, page, url, digest, text, names_first in zip(*columns, strict=True):
                if text is None:
                    told, said = (page, url, digest), names_first
                    continue
                payload, sha1 = text.encode(), base64.b32encode(bytes.fromhex(digest)).decode()
                size, first = len(payload), said if told == (page, url, digest) else None
                if archive != current:
                    close()
                    current, packer = archive, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out = stack.enter_context(store.create(f"{archive}.mono.warc.gz"))
                    names.append(f"{archive}")
                again = size >= min_bytes and first is not None and first != page
                out.write(packer.compress(record("revisit" if again else "response", url or "", page, payload, sha1, size, first)))
            yield batch(ARCHIVES, name=names)
        close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for rows in batches:
            for name in rows.column(0).to_pylist():
                target = f"{name}.warc.gz"
                normalise(store, f"{name}.mono.warc.gz", target)
                with store.open(f"{target}.idx") as f:
                    index = [line.split(" ", 2) for line in f.read().decode().splitlines()]
                out: list[list] = [[] for _ in READ.names]
                with store.open(target) as f:
                    for offset, length, _ in index:
                        headers, payload = read_member(f, int(offset), int(length))
                        kind, sha1 = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        size = len(payload) if kind == "response" else int(headers["warc-payload-length"])
                        if kind == "response" and sha1_base32(payload) != sha1:
                            raise ValueError(f"{target} at {offset}: the payload doesn't have its digest")
                        refers = page_in(headers["warc-refers-to"]) if kind == "revisit" else None
                        for column, value in zip(out, (page_in(headers["warc-record-id"]), size, sha1, kind, refers, target, int(offset)), strict=True):
                            column.append(value)
                yield batch(READ, **dict(zip(READ.names, out, strict=True)))

    archives = max(1, pages.count() // pages_an_archive)
    archive = F.pmod(F.xxhash64("page_id", "url"), F.lit(archives)).cast("int").alias("archive")
    text = F.coalesce("html", F.lit(""))
    keyed = pages.select(archive, "page_id", "url", F.sha1(text).alias("digest"), text.alias("payload"))
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Payloads go through one shuffle, by archive; the first pages join their digests and travel beside them.
    told = keyed.select("archive", "page_id", "url", "digest").distinct().join(firsts.select("digest", "first"), "digest")
    rows = told.withColumn("payload", F.lit(None).cast("string")).unionByName(keyed.withColumn("first", F.lit(None).cast("long")))
    order = ["archive", "page_id", "url", "digest", F.col("payload").isNotNull()]
    laid = rows.repartition(archives, "archive").sortWithinPartitions(*order).select("archive", "page_id", "url", "digest", "payload", "first")
    work = Workspace(spark, "warc-list")
    names = work.save(laid.mapInArrow(write, "name string"), "archives")
    found = names.distinct().repartition(archives, "name").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")
    return work.save(found, "records")
