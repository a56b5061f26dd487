"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent frames, each of some records, and a last skippable
frame with a seek table (the published seekable format: compressed and decompressed size of
each frame, footer magic). The index maps a record to bundle, frame and offset within the
frame, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, scratch, split_uri, staged, write_file

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Parts that the copies of one payload are dealt to.
PARTS = 16
#: Payloads below this many bytes are always stored in full.
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"


def decisions(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, payload_digest, refers_to) of rows that revisit an earlier equal payload.

    Only digests go through the shuffle, with partial minima first. Rows that share the
    smallest page_id of a payload are all stored in full.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    narrow = narrow.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # a payload's copies are dealt to PARTS, so that no task gets all of a hot one's
    first = first.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    narrow = narrow.withColumn("p", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int"))
    return narrow.join(first, ["payload_digest", "p"]).where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _uri(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header, the digest and size, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or f'urn:page:{page_id}', safe=SAFE)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = "".join(map(chr, range(33, 127)))
_PAYLOAD_SIZE = re.compile(rb"\r\ncontent-length: *([0-9]+)", re.I)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    end = stop + 4 + int(head["content-length"])
    return head, data[stop + 4 : end], end + 4


class Bundle:
    """Writer of one bundle: records into frames, the seek table at the end."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes = frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out, self.frames, self.held = bytearray(), [], bytearray()

    def add(self, rec: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length) of the record."""
        if self.held and len(self.held) + len(rec) > self.frame_bytes:
            self._frame()
        place = (len(self.frames), len(self.held), len(rec))
        self.held += rec
        return place

    def _frame(self) -> None:
        packed = self.zstd.compress(bytes(self.held))
        self.frames.append((len(packed), len(self.held)))
        self.out += packed
        self.held = bytearray()

    def close(self) -> bytes:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer


class BundleReader:
    """Frames of a bundle by number, by way of its seek table."""

    def __init__(self, uri: str):
        store, path = split_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = struct.unpack(f"<{2 * n}I", self.file.read_at(8 * n, size - 9 - 8 * n))
        self.sizes = list(zip(table[::2], table[1::2]))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, full = self.sizes[k]
        return self.zstd.decompress(self.file.read_at(packed, self.starts[k]), max_output_size=full)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]

    def close(self) -> None:
        self.file.close()


def write_bundles(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write one record per row; return the index, staged: (page_id, path, frame, offset, length).

    Null html is an empty payload; null urls and ids are written as such; repeated rows are
    records of their own. Bundles of task attempts that failed are in no index row.
    """
    repeat = decisions(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = rows.join(repeat, ["page_id", "payload_digest"], "left")

    def run(it):
        bundle, places, path = Bundle(frame_bytes), [], ""

        def flush():
            write_file(path, bundle.close())
            ids, frames, offsets, lengths = zip(*places)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([path] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "path", "frame", "offset", "length"])

        for batch in batches_of(it):
            for page_id, digest, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not places:
                    path = posixpath.join(folder, f"{uuid.uuid4().hex}.warc.zst")
                places.append((page_id, *bundle.add(record(page_id, url, html.encode(), digest, refers_to))))
                if len(bundle.out) >= bundle_bytes:
                    yield flush()
                    bundle, places = Bundle(frame_bytes), []
        if places:
            yield flush()

    rows = rows.select("page_id", "payload_digest", "url", "html", "refers_to")
    return staged(rows.mapInArrow(run, "page_id long, path string, frame int, offset long, length long"), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the index, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, frame, offset.

    A response's digest and size are taken from its payload and must agree with its headers.
    """

    def run(it):
        for pdf in it:
            for (path, frame), own in pdf.groupby(["path", "frame"], sort=False):
                bundle = BundleReader(path)
                data = bundle.frame(int(frame))
                bundle.close()
                out = []
                for offset in own["offset"]:
                    head, block, _ = parse(data, int(offset))
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(_PAYLOAD_SIZE.search(http)[1])
                    kind = head["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record in {path}, frame {frame}, offset {offset}")
                    refers = head.get("x-refers-to-page")
                    out.append((int(head["x-page-id"]) if head["x-page-id"] else None, size, digest, kind, int(refers) if refers else None, head["warc-target-uri"], int(frame), int(offset)))
                cols = list(zip(*out))
                yield pd.DataFrame({"page_id": pd.array(cols[0], "Int64"), "payload_bytes": cols[1], "payload_digest": cols[2], "record_type": cols[3], "refers_to": pd.array(cols[4], "Int64"), "url": cols[5], "frame": cols[6], "offset": cols[7]})

    spread = index.select("path", "frame", "offset").repartition("path", "frame").sortWithinPartitions("path", "frame", "offset")
    return spread.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, frame int, offset long")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles in the shared folder and read every record back."""
    return read_bundles(write_bundles(pages, scratch(pages.sparkSession, "warc")))
