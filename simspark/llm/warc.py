"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a bundle ends with a skippable frame that holds a
seek table (the public seekable format: sizes of every frame, then a fixed footer), so any Zstandard reader reads the bundle as a
whole, and one that knows the table reads one frame alone. An index maps each record to bundle, frame and offset in the frame.

Of records with equal payloads of at least `min_bytes` bytes the one with the smallest id is a response, the others revisit it.

Cases: a null html counts as an empty payload; a null url is written as an empty target; rows with a null id are written, as
responses unless a row with an id holds the same payload; rows that repeat the smallest id with the same payload are all
responses; very long payloads get a frame of their own; an empty table gives no archive and an empty index. Other columns are
ignored. Bundles are written under a temporary name and then renamed, so a task that is run again does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import Workspace, table

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEK_FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "bundle string, frame int, offset long, length long, page_id long, record_type string, refers_to long"
#: Fixed value of the WARC standard.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, which tell the payload's length, and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {IDENTICAL_PAYLOAD}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC headers, HTTP headers, payload, end) of the record that starts at `at`."""
    data = bytes(data) if isinstance(data, memoryview) else data
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not the start of a record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start, size = stop + 4, int(head["Content-Length"])
    inner = data.index(b"\r\n\r\n", start) + 4
    http = dict(x.split(": ", 1) for x in data[start : inner - 4].decode().split("\r\n")[1:])
    return head, http, data[inner : start + size], start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEK_FOOTER_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class BundleWriter:
    """Writes one bundle frame by frame; only the frame at hand is in memory."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        import zstandard

        self.fs, self.path, self.hidden = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.hidden)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.open, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) that the record gets."""
        if self.open and self.size + len(record) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.open.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.open:
            self.out.write(packed := self.compress(b"".join(self.open)))
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.hidden, self.path)


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_FOOTER_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", self.file.read(8 * n))
        self.starts, self.sizes, self.full = [0], sizes[::2], sizes[1::2]
        for x in self.sizes:
            self.starts.append(self.starts[-1] + x)
        self.unpack = zstandard.ZstdDecompressor().decompress

    @lru_cache(2)  # noqa: B019  readers live as long as their task
    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return self.unpack(self.file.read(self.sizes[k]), max_output_size=self.full[k])


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    # the digests are made in the same pass on both sides of the join; only those that repeat come back to the payloads
    key = F.sha1(F.col("payload").cast("binary"))
    other_key = F.md5(F.col("payload").cast("binary"))  # tells payloads apart that were made to share a digest
    seen = rows.where(F.octet_length("payload") >= min_bytes).select(key.alias("digest"), other_key.alias("check"), "page_id")
    first = seen.groupBy("digest", "check").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    other = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    joined = rows.withColumns({"digest": key, "check": other_key}).join(first, ["digest", "check"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, ws: Workspace, min_bytes: int = 0) -> DataFrame:
    """Write a record per row into bundles under the workspace; return the saved index."""
    root = f"{ws.path}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base)
        part, k, writer, rows = TaskContext.get().partitionId(), 0, None, []

        def done() -> pa.RecordBatch:
            writer.close()
            columns = list(zip(*rows))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if writer is None:
                    name = f"part-{part:05d}-{k:04d}.warc.zst"
                    writer = BundleWriter(fs, f"{base}/{name}")
                record = build_record(page_id, url, payload.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                frame, offset = writer.add(record)
                rows.append((f"{root}/{name}", frame, offset, len(record), page_id, "response" if refers is None else "revisit", refers))
                if writer.written >= BUNDLE_BYTES:
                    yield done()
                    writer, rows, k = None, [], k + 1
        if writer is not None:
            yield done()

    return ws.save(mark_revisits(pages, min_bytes).mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that rows of an index name, each through its frame, and check their payloads' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for batch in batches:
            found = []
            for bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                if bundle != uri:
                    uri, reader = bundle, BundleReader(bundle)
                head, http, payload, _ = parse_record(reader.frame(frame), offset)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = head["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{head['WARC-Record-ID']} in {bundle}: the payload doesn't match its digest")
                ids = [int(x) if (x := head.get(h, "<urn:page:>")[10:-1]) else None for h in ("WARC-Record-ID", "WARC-Refers-To")]
                found.append((ids[0], int(http["Content-Length"]), digest, kind, ids[1], head["WARC-Target-URI"], payload if kind == "response" else None))
            columns = list(zip(*found)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return index.select("bundle", "frame", "offset").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), Workspace(spark, "op4"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
