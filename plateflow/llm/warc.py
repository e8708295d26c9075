"""WARC (operator 4): pages as archives, and a normaliser for archives that are one gzip stream."""

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.common import schema, staged
from plateflow.operators.skew import shared_folder

#: Bytes of records, uncompressed, after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes read or inflated at once.
CHUNK = 1 << 20
#: Records with equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
INDEX = "archive string, record long, offset long, length long, page_id long"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, url string, payload binary"
_FIXED_DATE = datetime(2000, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain path, which is what a session without a cluster has."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; it carries the digest and size of the payload it
    stands for. Line breaks in the address are escaped, so that a header stays one line."""
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_FIXED_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if kind == "revisit" else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Splits the bytes of an archive into records, however they arrive."""

    def __init__(self):
        self.rest = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.rest += data
        while len(self.rest) >= max(self.need, 1):
            end = self.rest.find(b"\r\n\r\n")
            if end < 0:
                return
            size = next(int(line[15:]) for line in bytes(self.rest[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
            self.need = end + 4 + size + 4
            if len(self.rest) < self.need:
                return
            yield bytes(self.rest[: self.need])
            del self.rest[: self.need]
            self.need = 0


def inflated(stream) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, read once from front to end."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = inflate.decompress(data, CHUNK)
            if out:
                yield out
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)


def normalise(source: str, target: str) -> list[tuple[int, int, int, int | None]]:
    """Rewrite ``source``, a gzip archive of any shape, as ``target`` with one member per record, and write
    the offset index beside it. Both appear under their names only when whole, so that a repeated or
    abandoned task leaves nothing half written. Returns (record, offset, length, page_id) rows."""
    system, path = opened(source)
    rows, at, records, mark = [], 0, Records(), uuid.uuid4().hex
    with system.open_input_stream(path, compression=None) as stream, system.open_output_stream(f"{opened(target)[1]}.{mark}", compression=None) as out:
        for data in inflated(stream):
            for record in records.feed(data):
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record) + deflate.flush()
                rows.append((len(rows), at, len(member), parse(record)["page_id"]))
                at += len(member)
                out.write(member)
    if records.rest:
        raise ValueError(f"{source} ends inside a record")
    lines = "".join(json.dumps({"record": r, "offset": o, "length": n, "page_id": p}) + "\n" for r, o, n, p in rows)
    with system.open_output_stream(f"{opened(target)[1]}.idx.{mark}", compression=None) as out:
        out.write(lines.encode())
    system.move(f"{opened(target)[1]}.{mark}", opened(target)[1])
    system.move(f"{opened(target)[1]}.idx.{mark}", f"{opened(target)[1]}.idx")
    return rows


def parse(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"][5:],
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "url": fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": None if fields["WARC-Type"] == "revisit" else block[:-4],
    }


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload a page with a larger id has as well. The largest
    id per digest comes from a partial aggregation; payloads are not shuffled."""
    large = pages.filter(F.length(_payload()) >= least_bytes)
    seen = staged(large.select("page_id", F.sha1(_payload()).alias("digest")), "digests")
    last = staged(
        seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_low")).filter("_low < refers_to").drop("_low"), "last"
    )
    return seen.join(last, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write one record per row of ``pages (page_id, url, html)`` and return the index
    ``(archive, record, offset, length, page_id)``.

    Each task streams its rows into archives of bounded size, one gzip stream each, and normalises an
    archive as soon as it is full: it inflates the stream once, writes every record as a member of its
    own with the offset index beside it, and deletes the stream. A null html is an empty payload.
    Pages with equal payloads of ``least_bytes`` or more: the largest page_id is a response, the
    others revisit it; rows that share that page_id are all responses. A null page_id is a response.
    """
    keyed = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(_payload()))
    typed = keyed.join(revisits(pages, least_bytes), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{folder.rstrip('/')}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        system, _ = opened(folder)
        system.create_dir(opened(folder)[1], recursive=True)
        number, size, out, deflate = 0, 0, None, None

        def close() -> pa.RecordBatch:
            out.write(deflate.flush())
            out.close()
            rows = normalise(f"{stem}-{number}.whole.gz", f"{stem}-{number}.warc.gz")
            system.delete_file(opened(f"{stem}-{number}.whole.gz")[1])
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{stem}-{number}.warc.gz"] * len(rows)), *(pa.array(c, pa.int64()) for c in columns)],
                names=["archive", "record", "offset", "length", "page_id"],
            )

        for batch in batches:
            for page_id, url, html, to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    out = system.open_output_stream(opened(f"{stem}-{number}.whole.gz")[1], compression=None)
                    deflate, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0
                kind = "response" if to.as_py() is None else "revisit"
                data = record_bytes(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "replace"), kind, to.as_py())
                out.write(deflate.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, out = number + 1, None
        if out is not None:
            yield close()

    return staged(typed.mapInArrow(run, schema(INDEX)), "index")


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records at the places of an index, one row each: seek, inflate one member, parse and check it.
    ``payloads`` also returns the payload; a revisit has none. A payload that does not have its digest
    stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for archive, offset, length in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if archive != path:
                        system, local = opened(archive)
                        stream, path = system.open_input_file(local), archive
                    stream.seek(offset)
                    row = parse(zlib.decompress(stream.read(length), 31))
                    if row["payload"] is not None and digest(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"{archive} at {offset}: the payload is not what its digest says")
                    if not payloads:
                        row["payload"] = None
                    rows.append(row | {"archive": archive, "offset": offset})
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return index.select("archive", "offset", "length").mapInArrow(run, schema(RECORDS))


def archive_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")
