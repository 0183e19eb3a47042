"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with some whole WARC/1.1 records, closed by a seek table in a skippable
frame (the seekable format published with Zstandard). The index has, for each record, its bundle, frame and offset in the
frame, so that one record is read by unpacking one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import cut, few_parts, get_bytes, put_bytes, shared_dir, small

#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Unpacked bytes after which a frame is closed, and packed bytes after which a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Payloads shorter than this are stored every time.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id long, record_id string, bundle string, frame int, at long"
INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64())])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def one_line(text: str | None) -> str:
    """A header value: line breaks would end it."""
    return "".join(c if c >= " " else " " for c in text or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record (without its payload) if refers_to is given."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers by lower-case name, block, where the next record starts) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = end + 4
    stop = start + int(headers["content-length"])
    return headers, data[start:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (packed, unpacked) size of every frame, then their number, a flag byte and the magic number."""
    body = b"".join(struct.pack("<2I", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<2I", SKIPPABLE, len(body)) + body


def read_seek_table(data: memoryview) -> list[tuple[int, int]]:
    """(offset, packed size) of each frame of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.unpack(f"<{2 * n}I", data[-9 - 8 * n : -9])[::2]
    out, at = [], 0
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read_frame(data: memoryview, frame: int) -> bytes:
    import zstandard

    at, size = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(bytes(data[at : at + size]))


def fetch(bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    return parse_record(read_frame(get_bytes(bundle), frame), at)[:2]


class BundleWriter:
    """Packs records into frames and frames into bundles; holds one bundle in memory."""

    def __init__(self, prefix: str, level: int = 3):
        import zstandard

        self.pack, self.prefix, self.k = zstandard.ZstdCompressor(level=level).compress, prefix, 0
        self.frames, self.sizes, self.open, self.index, self.size = [], [], [], [], 0

    def add(self, page_id: int | None, record: bytes) -> list[tuple]:
        """Take a record; the index rows of a bundle that this completes, else none."""
        self.index.append((page_id, record_id(page_id), f"{self.prefix}-{self.k:05d}.warc.zst", len(self.frames), self.size))
        self.open.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.close_frame()
        return self.close() if sum(x for x, _ in self.sizes) >= BUNDLE_BYTES else []

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.pack(b"".join(self.open)))
            self.sizes.append((len(self.frames[-1]), self.size))
            self.open, self.size = [], 0

    def close(self) -> list[tuple]:
        self.close_frame()
        done = self.index
        if done:
            put_bytes(f"{self.prefix}-{self.k:05d}.warc.zst", [*self.frames, seek_table(self.sizes)])
        self.k, self.frames, self.sizes, self.index = self.k + 1, [], [], []
        return done


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row to bundles below path; return the index (page_id, record_id, bundle, frame, at).

    Of rows with the same payload of `least` bytes or more, the one with the largest page_id is stored and the others are
    revisits of it; rows that repeat that page_id are stored each. A null html is an empty payload. A null page_id is never a
    revisit and never referred to. Other columns are ignored; an empty table gives an empty index.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    long = F.octet_length("html") >= least
    twice = rows.filter(long & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = small(cut(twice, "warc-payloads").withColumnRenamed("sha1", "_key"))
    # payloads that are stored every time have keys of their own, so that a shuffle for the join, if it takes one, spreads them
    key = F.when(long, F.col("sha1")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))
    rows = rows.withColumn("_key", key).join(twice, "_key", "left")
    to = F.when(long & F.col("page_id").isNotNull() & (F.col("kept") != F.col("page_id")), F.col("kept"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a repeated task may meet its rows in another order: its bundles are its own, and the index has those of one attempt
        task = TaskContext.get()
        out = BundleWriter(f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}")
        for batch in batches:
            done = []
            for i, u, h, s, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done += out.add(i, make_record(i, u, h.encode(), s, r, date))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX_ARROW.names, x, strict=True)) for x in done], INDEX_ARROW)
        if done := out.close():
            yield pa.RecordBatch.from_pylist([dict(zip(INDEX_ARROW.names, x, strict=True)) for x in done], INDEX_ARROW)

    return cut(rows.select("page_id", "url", "html", "sha1", to.alias("refers_to")).mapInArrow(write, INDEX), "warc-index")


def read_warc(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles (a column `bundle`), checked against its digest: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle in (b for batch in batches for b in batch.column(0).to_pylist()):
            data = get_bytes(bundle)
            for frame in range(len(read_seek_table(data))):
                text, at, rows = read_frame(data, frame), 0, []
                while at < len(text):
                    h, block, at = parse_record(text, at)
                    digest, n = h["warc-payload-digest"].partition(":")[2], int(h["x-payload-length"])
                    if h["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{bundle}, frame {frame}: a payload differs from its digest")
                    rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, n, digest, h["warc-type"], int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, h["warc-target-uri"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = cut(bundles.select("bundle").distinct(), "warc-bundles")
    return files.repartition(few_parts(files.sparkSession, files.count())).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to bundles in the shared folder, and read them back."""
    return read_warc(write_warc(pages, shared_dir(pages.sparkSession, "warc")))
