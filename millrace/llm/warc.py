"""Web archives: writing pages as records, and reading the records back one by one.

A record is one gzip member. The reader inflates members in small pieces, takes the block
by its declared length and compares digests, so it holds one record at a time.

Pages with equal payloads of ``revisit_from`` bytes or more are stored once: the record of
the smallest page_id is the response, the others are revisits that refer to it. A null
html is an empty payload. A page without id is always a response. Rows that repeat both
page_id and payload get equal records. A record whose bytes differ from its digest is
marked; a broken frame raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import saved
from millrace.session import scratch_path

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 16
#: Bytes of payload in one batch of rows.
BATCH_BYTES = 4 << 20
#: Longest header of a record.
HEADER_BYTES = 1 << 20

_ID = "urn:millrace:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value: line breaks and controls are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    name = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"{_ID}{page_id}"
    head += [f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return deflate.compress(whole) + deflate.flush()


def with_record_types(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, html and, for revisits, the page they refer to."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    light = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= revisit_from)).select(
        "page_id", digest.alias("digest")
    )
    shared = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = shared.where("first < last").drop("last")
    later = light.join(shared, "digest").where("page_id > first").distinct()
    later = saved(later, "revisits")
    return (
        pages.withColumn("digest", digest)
        .join(later, ["page_id", "digest"], "left")
        .select("page_id", "url", "html", F.col("first").alias("refers_to"))
    )


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page below folder, which all executors share.

    Returns path and record count of each archive. A task that runs twice writes files of
    other names; those of lost attempts are not in the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out, names, counts, written = None, [], [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, refers_to = (column[row].as_py() for column in batch.columns)
                if out is None:
                    names.append(f"{stem}-{len(names):05d}.warc.gz")
                    counts.append(0)
                    # Members are compressed already, whatever the file's name says.
                    out, written = store.open_output_stream(f"{top}/{names[-1]}", compression=None), 0
                member = record(page_id, url, html.encode(), refers_to)
                out.write(member)
                written += len(member)
                counts[-1] += 1
                if written >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        paths = pa.array([f"{folder}/{n}" for n in names], pa.string())
        yield pa.RecordBatch.from_arrays([paths, pa.array(counts, pa.int64())], names=["path", "records"])

    return saved(with_record_types(pages, revisit_from).mapInArrow(run, "path string, records long"), "archives")


class _Member:
    """Bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source, spare: bytes):
        self.source, self.deflated, self.plain = source, spare, bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate a piece; false at the member's end."""
        while not self.inflate.eof:
            data = self.deflated or self.source.read(READ_BYTES)
            if not data:
                raise ValueError("an archive ends inside a record")
            piece = self.inflate.decompress(data, READ_BYTES)
            self.deflated = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if piece:
                self.plain += piece
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """What stands before the mark, which goes too."""
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if seen > most or not self.more():
                raise ValueError("a record without a complete header")
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    def exactly(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise ValueError("a record shorter than its declared length")
        found = bytes(self.plain[:n])
        del self.plain[:n]
        return found

    def rest(self) -> bytes:
        while len(self.plain) <= 4 and self.more():
            pass
        return bytes(self.plain)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name.removeprefix(_ID)) if name.startswith(_ID) else None


def read_records(source) -> Iterator[dict]:
    """Records of an archive in their order."""
    spare = b""
    while spare or (spare := source.read(READ_BYTES)):
        member = _Member(source, spare)
        head = _fields(member.until(b"\r\n\r\n", HEADER_BYTES))
        block = member.exactly(int(head["content-length"]))
        if member.rest() != b"\r\n\r\n":
            raise ValueError("a record longer than its declared length")
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["warc-type"] == "revisit"
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = declared if revisit else sha1_base32(payload)
        yield {
            "page_id": _page(head.get("warc-record-id")),
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")),
            "payload_bytes": int(_fields(http)["content-length"]),
            "payload_digest": digest,
            "intact": head.get("warc-block-digest") == f"sha1:{sha1_base32(block)}" and digest == declared,
            "payload": None if revisit else payload,
        }
        spare = member.deflated


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary()),
    ]
)


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives listed in column ``path``, one archive per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for found in read_records(source):
                        size += len(found["payload"] or b"") + 200
                        held.append(found if payloads else found | {"payload": None})
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, _RECORD)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, _RECORD)

    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, intact boolean, payload binary"
    )
    paths = archives.select("path").repartition(max(1, archives.count()))
    return paths.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back: what the archives say of each page."""
    spark = pages.sparkSession
    read = read_archives(spark, write_archives(pages, scratch_path(spark, "warc")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
