"""WARC archives as seekable Zstandard bundles, written and read by Spark tasks.

A bundle is one file: WARC records grouped into independent Zstandard frames of bounded size, then a
skippable frame with the map from record identifiers to (frame, offset in the frame, length), then a
skippable frame with the seek table (compressed and uncompressed size of every frame) in the seekable
format, which ends the file. Any Zstandard reader can read the whole; a record alone costs one frame.

Tasks sort their rows before writing, so a retried task writes the same bytes; a file appears under
its name only when it is complete. Payloads that stand more than once become revisit records: equal
payloads are found by digest with partial aggregation, never by gathering a group.

Defined results: a null payload is empty; payloads below ``min_revisit`` bytes are always responses;
of equal payloads all rows with the smallest id are responses, the rest revisit it; a row with a null
id revisits the smallest id if there is one. Repeated rows are written as often as they stand.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.llm.frames import fresh_path

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
_WRITTEN = "path string, bundle_bytes long, records long"
_READ = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, path string, frame int, frame_offset long, intact boolean"
)


def mark_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """Adds payload, its digest and, for revisits, the id of the response they refer to."""
    pages = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    first = (
        pages.where(F.length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND first_id IS NOT NULL")
        .select("digest", "first_id")
    )
    marked = pages.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return marked.select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to")
    )


# Fixed value: what a URI may hold beside letters, digits and ``_.-~``; all else is percent-escaped.
_URI = ":/?#[]@!$&'()*+,;=%"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and length of the full payload, not the payload.

    The target URI is the url, percent-escaped where it holds what no URI may; a null url has no such field.
    """
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_URI)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; ``finish`` gives the bytes of the file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = 0
        self.index: list[tuple[int | None, int, int, int]] = []
        self.size = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.frame_bytes:
            self._close_frame()
        self.index.append((page_id, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.size += len(record)

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append((self.compressor.compress(b"".join(self.open)), self.open_bytes))
        self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        listing = self.compressor.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", len(data), size) for data, size in self.frames)
        foot = table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(
            [
                *(data for data, _ in self.frames),
                struct.pack("<II", INDEX_MAGIC, len(listing)) + listing,
                struct.pack("<II", SKIPPABLE_MAGIC, len(foot)) + foot,
            ]
        )


class BundleReader:
    """Random access to a bundle's records through its footer."""

    def __init__(self, data: bytes) -> None:
        count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        self.data = data
        at = len(data) - 9 - 8 * count
        sizes = [struct.unpack_from("<II", data, at + 8 * i) for i in range(count)]
        self.frames, start = [], 0
        for packed, size in sizes:
            self.frames.append((start, packed, size))
            start += packed
        _, listed = struct.unpack_from("<II", data, start)
        self.decompressor = zstandard.ZstdDecompressor()
        listing = self.decompressor.decompress(data[start + 8 : start + 8 + listed])
        self.index = json.loads(listing)

    def frame(self, number: int) -> bytes:
        start, packed, size = self.frames[number]
        return self.decompressor.decompress(self.data[start : start + packed], max_output_size=max(size, 1))

    def record(self, page_id: int | None) -> bytes | None:
        """The first record with an identifier, reading its frame alone."""
        for found, number, offset, length in self.index:
            if found == page_id:
                return self.frame(number)[offset : offset + length]
        return None


def parse_record(record: bytes) -> dict:
    """Fields of one record; ``intact`` tells whether the payload has the digest its header gives."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else number(fields["WARC-Refers-To"]),
        "payload_bytes": len(payload) if response else length,
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else digest,
        "payload": payload if response else None,
        "intact": not response or (length == len(payload) and hashlib.sha256(payload).hexdigest() == digest),
    }


def write_bundles(marked: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the rows of ``mark_revisits`` to ``folder``; one row per file, files are written when it is read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        bundle, number = Bundle(frame_bytes), 0

        def close() -> pa.RecordBatch:
            name = f"{root}/part-{task.partitionId():06d}-{number:06d}.warc.zst"
            draft = f"{root}/.{task.taskAttemptId()}-{number}"
            data = bundle.finish()
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, name)
            return pa.RecordBatch.from_pydict(
                {"path": [name], "bundle_bytes": [len(data)], "records": [len(bundle.index)]}
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))
            for row in zip(*columns, strict=True):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in row)
                bundle.add(page_id, record_bytes(page_id, url, payload, digest, refers_to))
                if bundle.size >= bundle_bytes:
                    yield close()
                    bundle, number = Bundle(frame_bytes), number + 1
        if bundle.index:
            yield close()

    return marked.sortWithinPartitions("page_id", "digest", "url").mapInArrow(write, _WRITTEN)


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all bundles of a folder, with its place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                reader = BundleReader(content.as_py())
                by_frame: dict[int, list[tuple[int, int]]] = {}
                for _, number, offset, length in reader.index:
                    by_frame.setdefault(number, []).append((offset, length))
                for number, places in by_frame.items():
                    data = reader.frame(number)
                    rows = [
                        parse_record(data[o : o + n]) | {"path": path.as_py(), "frame": number, "frame_offset": o}
                        for o, n in places
                    ]
                    schema = schema or _arrow_schema()
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(read, _READ)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in _READ.split(", "))])


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, then reads the archives back."""
    folder = fresh_path(spark, "warc")
    write_bundles(mark_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder).write.format("noop").mode(
        "overwrite"
    ).save()
    back = read_bundles(spark, folder)
    return back.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


OP10_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first_id FROM p
    WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to,
       true AS intact
FROM p LEFT JOIN f USING (payload_digest)
"""
