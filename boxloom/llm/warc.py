"""WARC records in seekable Zstandard bundles.

A bundle is a row of data frames, each an independent Zstandard frame that holds a few whole
records, and a footer: a skippable frame with the seek table of the public seekable format
(compressed and decompressed size of every frame). The bundle's record map gives frame number,
offset inside the decompressed frame and length of every record, so one record is read by
decompressing one frame. Bundles and record maps are rows of a Parquet table, which any file
system that Spark knows can hold; the map is read without the content.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import arrow, work_path

LEAST_SHARED = 100  # payloads below this size are never revisits
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP head only and names the record that holds the payload."""
    block = HTTP + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


class Bundle:
    """Frames and record map that are being written."""

    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.map: list[dict] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.map.append({"record_id": record_id, "frame": len(self.frames), "offset": self.filled, "length": len(data)})
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.size += len(frame)
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class Seekable:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        step = 12 if flags & 0x80 else 8
        start = len(data) - 9 - step * count
        self.data, self.places, at = data, [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", data, start + i * step)
            self.places.append((at, packed, plain))
            at += packed
        self.opener = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            at, packed, plain = self.places[frame]
            self.last = (frame, self.opener.decompress(self.data[at:at + packed], max_output_size=plain))
        return self.last[1][offset:offset + length]


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """(key, url, html, digest, refers_to): digest of the payload, and for a repeated payload of at
    least `least` bytes the smallest key that has it, unless the row has that key itself.

    The join side holds repeated payloads only, one row each; an adaptive skew join splits the rows
    of one payload.
    """
    rows = pages.select(F.col(key), F.col(url), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    sized = rows.where(F.octet_length("html") >= least)
    firsts = sized.groupBy("digest").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    joined = rows.join(firsts, "digest", "left")
    return joined.select(key, url, "html", "digest", F.when(F.col("__first") != F.col(key), F.col("__first")).alias("refers_to"))


_MAP = "array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
_MAP_TYPE = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row as a table of bundles (bundle, records, content)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def close() -> pa.RecordBatch:
            content = bundle.finish()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([bundle.map], _MAP_TYPE), pa.array([content], pa.binary())],
                                              ["bundle", "records", "content"])

        for batch in batches:
            for i in range(len(batch)):
                page, link, text, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                data = record(page, link, text.encode("utf-8", "surrogatepass"), digest, refers_to, refers_to is not None)
                bundle.add(f"<urn:page:{page}>", data)
                if bundle.size + bundle.filled >= BUNDLE_BYTES:
                    yield close()
                    number, bundle = number + 1, Bundle()
        if bundle.map:
            yield close()

    arrow(with_revisits(pages, key, url, html), run, f"bundle string, records {_MAP}, content binary").write.parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of every record.

    Every record is read by its place in the record map. The payload of a revisit is null. A
    response whose payload does not have the size and digest of its head is an error.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(len(batch)):
                bundle = Seekable(batch.column(1)[b].as_py())
                held: list[tuple] = []
                size = 0
                for place in batch.column(0)[b].as_py():
                    fields, block = parse(bundle.read(place["frame"], place["offset"], place["length"]))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block[len(HTTP):] if kind == "response" else None
                    if fields["WARC-Record-ID"] != place["record_id"]:
                        raise ValueError(f"record map is wrong at {place}")
                    if payload is not None and (len(payload) != int(fields["X-Payload-Length"]) or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {place['record_id']} is damaged")
                    held.append((place["record_id"], fields["WARC-Target-URI"], kind, digest, int(fields["X-Payload-Length"]), fields.get("WARC-Refers-To"), payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield _records(held)
                        held, size = [], 0
                if held:
                    yield _records(held)

    return arrow(
        spark.read.parquet(path).select("records", "content"), run, "record_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      ["record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])


def archive_digest(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archive under the shared folder, read it back, and return one row per record.

    Null html is an empty payload, null urls are empty. Repeated rows have a record each; a null
    key comes back as null.
    """
    path = work_path(pages.sparkSession, "warc")
    write_archive(pages, path, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("None")).cast(kind)
    return read_archive(pages.sparkSession, path).select(
        number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
