"""WARC archives: records written as whole-file gzip streams, then normalised to one gzip member a record with an index.

write() packs one record per page into archives of about a fixed size, each one gzip stream over the whole file.
normalise() inflates such a stream once, in pieces, rewrites each record as a member of its own and lists where it lies.
read() takes the members by that index alone. An archive is a row (name, bytes); rows are written as tables in the shared
folder, so any store that Spark writes will do and a repeated task leaves no half-written file.

Of pages with equal payloads (of at least min_bytes) the one with the largest page_id is the response and the others revisit
it; rows that repeat the largest are responses too. The largest id of a payload comes from a pre-aggregated group-by over a
written table of ids and digests. A payload that more than a thousandth of all pages share goes out by broadcast (there are at
most a thousand), and pages get their roles by page_id and digest, so such a payload lies on no single task.

Nulls: a null html is an empty payload; a null url leaves out the target; rows without a page_id revisit the largest id of
their payload, or are responses where there is none. Repeated rows are written each. Long payloads are one record each, held
whole while they are packed. An empty table gives no archives. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import released
from .shared import spread_join, table, written

ARCHIVE_BYTES = 4 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = 31  # zlib's window bits for gzip


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, revisits: int | None) -> bytes:
    """A response, or a revisit (which holds the HTTP head but not the payload)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisits is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(revisits)}"]
    block = http if revisits is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:]) if k}


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file, in pieces; it may have one member or many. A file that ends early is an error."""
    stream, fed = zlib.decompressobj(MEMBER), False
    for chunk in chunks:
        while chunk:
            fed = True
            yield stream.decompress(chunk, 1 << 20)
            chunk = stream.unconsumed_tail
            if stream.eof:
                chunk, stream, fed = stream.unused_data, zlib.decompressobj(MEMBER), False
    if fed:
        raise ValueError("the archive ends inside a gzip member")


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a file, each whole, without its closing line breaks; the file is read once."""
    buffer = bytearray()
    need: int | None = None  # of the next record, once its header has been read
    for piece in inflated(chunks):
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(header(bytes(buffer[:end]))["content-length"])
            if len(buffer) < need + 4:
                break
            if buffer[need : need + 4] != b"\r\n\r\n":
                raise ValueError("a record is longer than its Content-Length")
            yield bytes(buffer[:need])
            del buffer[: need + 4]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def normalise(chunks: Iterable[bytes], level: int = LEVEL) -> Iterator[tuple[bytes, str, int]]:
    """(member, record id, offset) of every record, in order; the members joined are the new file."""
    at = 0
    for data in records(chunks):
        pack = zlib.compressobj(level, zlib.DEFLATED, MEMBER)
        member = pack.compress(data + b"\r\n\r\n") + pack.flush()
        yield member, header(data[: data.find(b"\r\n\r\n")])["warc-record-id"], at
        at += len(member)


def parse(member: bytes) -> dict:
    """What a member's record says; payload is None for a revisit."""
    data = zlib.decompress(member, MEMBER)
    end = data.find(b"\r\n\r\n")
    head = header(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.find(b"\r\n\r\n")
    page = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = head["warc-type"] == "revisit"
    payload = None if revisit else block[cut + 4 :]
    return {
        "page_id": page(head["warc-record-id"]),
        "payload_bytes": int(header(block[:cut])["content-length"]) if revisit else len(payload),
        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
        "record_type": head["warc-type"],
        "refers_to": page(head["warc-refers-to"]) if revisit else None,
        "payload": payload,
    }


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: whole-file gzip streams with one record per page."""
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1("html"))
    slim = known.select("page_id", "digest").where(F.octet_length("html") >= min_bytes)
    slim = written(pages.sparkSession, slim.distinct(), "digests")
    last = slim.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("ids")).where("last is not null and ids > 1")
    roles = spread_join(slim, last, "digest", "ids", slim.count(), "inner").where("page_id is null or page_id < last")
    roles = roles.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "last")
    dealt = known.join(roles, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        out, size, pack = [], 0, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{count:06d}"], "content": pa.array([b"".join(out) + pack.flush()], pa.binary())})

        for batch in batches:
            for page, url, text, refers in zip(*(batch.column(n) for n in ("page_id", "url", "html", "last")), strict=True):
                if pack is None:
                    out, size, pack = [], 0, zlib.compressobj(LEVEL, zlib.DEFLATED, MEMBER)
                data = record(page.as_py(), url.as_py(), text.as_buffer().to_pybytes(), refers.as_py())
                out.append(pack.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield closed()
                    count, pack = count + 1, None
        if pack is not None:
            yield closed()

    return dealt.select("page_id", "url", "html", "last").mapInArrow(run, "archive string, content binary")


INDEX = "array<struct<record:string,offset:bigint,length:bigint>>"


def normalised(archives: DataFrame) -> DataFrame:
    """archive, content (a member for each record), index (record, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes()
                made = list(normalise(data[i : i + 65536] for i in range(0, len(data), 65536)))
                index = [{"record": r, "offset": at, "length": len(m)} for m, r, at in made]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([b"".join(m for m, _, _ in made)], pa.binary()), pa.array([index], kind)], ["archive", "content", "index"])

    return archives.mapInArrow(run, f"archive string, content binary, index {INDEX}")


FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of normalised archives, taken by the index; the payload too if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, index in zip(batch.column("content"), batch.column("index"), strict=True):
                data = memoryview(content.as_buffer())
                rows = [parse(bytes(data[x["offset"] : x["offset"] + x["length"]])) for x in index.as_py()]
                out = {n: pa.array([r[n] for r in rows], k) for n, k in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payloads)}
                yield pa.RecordBatch.from_pydict(out)

    return archives.mapInArrow(run, FOUND + ", payload binary" * payloads)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes normalised archives as files (.warc.gz with a .idx beside each) under a folder that all executors mount; returns their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in batch.to_pylist():
                lines = "".join(f"{x['record']} {x['offset']} {x['length']}\n" for x in row["index"])
                for end, data in ((".warc.gz", row["content"]), (".idx", lines.encode())):
                    part = f"{folder}/.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, f"{folder}/{row['archive']}{end}")  # whole or not at all, whichever attempt comes last
                yield pa.RecordBatch.from_pydict({"name": [row["archive"] + ".warc.gz"], "records": [len(row["index"])]})

    return archives.mapInArrow(run, "name string, records bigint")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(spark, write(table(spark, sf_dir, "pages")), "warc")
    return read(written(spark, normalised(archives), "warc-members"))
