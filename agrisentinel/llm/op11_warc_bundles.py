"""WARC archives as seekable Zstandard bundles.

``write_archives`` writes one WARC/1.1 record per row.  Consecutive records are
grouped into frames of about ``frame_bytes``, each a Zstandard frame of its own; a
bundle (file) ends with a seek table in a skippable frame, so any frame can be read
without those before it, and any Zstandard reader can read the whole.  The index
that it returns maps each record identifier to (bundle, frame, offset in the
frame's contents, length).  ``read_archives`` deals the frames of all bundles over
tasks and parses them; ``fetch`` reads only the frames that hold wanted records.

Of the rows with equal payloads of at least ``min_payload`` bytes, one is a response
record with the payload: that with the largest id.  The others are revisit records
without it; they name the response and keep the payload's digest and length.

* Rows are stored once with a row number first, so that all later steps see the
  same rows; equal rows are records of their own (among equal largest ids the last
  stored is the response, the others are revisits of it).
* Only digests and row numbers are grouped.  Digests of more than ``HOT`` rows are
  joined apart: there are at most rows / HOT of them, broadcast if their size
  allows; the rest meet in a merge join.  Payloads are shuffled once, by row number.
* Tasks write bundles under names of their own; the stored index names those of
  the attempts that succeeded, and nothing else is read.

A null payload is empty.  A null id is smaller than any other; a null url is left
out of the record, and control characters in a url are percent-encoded.  Extra
columns, whatever their names, are ignored; an empty table gives no bundle.  A
payload longer than a frame gets a frame of its own (Zstandard seek tables allow
frames below 4 GB).  Reading checks every payload against its digest and fails if
they differ.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import broadcast_if_small, materialise, partitions, release

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
HOT = 100_000
LEVEL = 3

# The seekable format's magic numbers and the WARC profile of revisits.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, at int, length int"
RECORD = ("record_id string, id string, url string, record_type string, refers_to string, payload_bytes long, "
          "payload_digest string")


def _filesystem(folder: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/*", "file:///", folder)))


def record_id(page: str | None, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def page_of(record: str) -> str | None:
    return record.removeprefix("urn:page:").rpartition(":")[0] or None


def warc_record(page, row, url, payload: bytes, n_bytes: int, digest: bytes, refers_to: str | None, date: str) -> bytes:
    """The bytes of one record; ``payload`` counts only where ``refers_to`` is none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id(page, row)}>",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(contents: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and end of the record at ``at``."""
    stop = contents.index(b"\r\n\r\n", at)
    lines = contents[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict((name.lower(), value.strip()) for name, _, value in (line.partition(":") for line in lines[1:]))
    begin = stop + 4
    end = begin + int(head["content-length"])
    return head, contents[begin:end], end + 4


class _Bundle:
    """A file of frames, closed with its seek table."""

    def __init__(self, folder: str):
        import zstandard

        files, path = _filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.open = bytearray()
        self.size = 0

    def add(self, record: bytes, frame_bytes: int) -> tuple[int, int]:
        if self.open and len(self.open) + len(record) > frame_bytes:
            self.end_frame()
        at = len(self.open)
        self.open += record
        self.size += len(record)
        return len(self.frames), at

    def end_frame(self) -> None:
        packed = self.zstd.compress(bytes(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.open)))
        self.open = bytearray()

    def close(self) -> None:
        if self.open:
            self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """``(offset, packed size, size)`` of each frame of an open bundle, from its end."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("the file has no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    table = source.read(n * width)
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _write(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for row, page, url, payload, n_bytes, digest, of_page, of_row in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is not None and bundle.size > bundle_bytes:
                    bundle.close()
                    bundle = None
                bundle = bundle or _Bundle(folder)
                refers_to = None if of_row is None else record_id(of_page, of_row)
                record = warc_record(page, row, url, payload or b"", n_bytes, digest, refers_to, date)
                rows.append((record_id(page, row), bundle.name, *bundle.add(record, frame_bytes), len(record)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                    names=["record_id", "bundle", "frame", "at", "length"])
        if bundle is not None:
            bundle.close()
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                   date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Write the bundles into ``folder`` (a new one) and return the stored index of their records."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "page", "url", "payload",
                       F.octet_length("payload").cast("long").alias("n_bytes"), F.unhex(F.sha1("payload")).alias("digest"))
    rows = stored = materialise(rows, "op11-rows", compression="zstd")
    keys = rows.where(F.col("n_bytes") >= min_payload).select("digest", "page", "row")
    shared = (keys.groupBy("digest").agg(F.max(F.struct("page", "row")).alias("of"), F.count(F.lit(1)).alias("c"))
                  .where("c > 1"))
    shared = materialise(shared, "op11-shared")
    hot = broadcast_if_small(shared.where(F.col("c") > HOT), 64)
    cold = shared.where(F.col("c") <= HOT)
    revisits = (keys.join(hot, "digest")
                    .unionByName(keys.join(hot, "digest", "left_anti").join(cold.hint("merge"), "digest"))
                    .where(F.col("row") != F.col("of.row"))
                    .select("row", F.col("of.page").alias("of_page"), F.col("of.row").alias("of_row")))
    rows = (rows.join(revisits.hint("merge"), "row", "left")
                .select("row", F.col("page").cast("string").alias("page"), "url",
                        F.when(F.col("of_row").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest",
                        F.col("of_page").cast("string").alias("of_page"), "of_row"))
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    index = materialise(rows.mapInArrow(_write(folder, frame_bytes, bundle_bytes, date), INDEX), "op11-index")
    release(shared)
    release(stored)
    return index


def _frames(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{path}/{name}") as source:
                    table = seek_table(source)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(table)), pa.array(range(len(table)), pa.int32()),
                     *(pa.array([f[i] for f in table], pa.int64()) for i in range(3))],
                    names=["bundle", "frame", "at", "packed", "size"])
    return run


def _open_frame(source, at: int, packed: int, size: int) -> bytes:
    import zstandard

    source.seek(at)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size)


def _describe(head: dict, block: bytes) -> tuple:
    """A row of ``RECORD`` and the payload, checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    record = head["warc-record-id"][1:-1]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    n_bytes = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    if head["warc-type"] == "response":
        if len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {record} does not match its digest")
    refers = head.get("warc-refers-to")
    return ((record, page_of(record), head.get("warc-target-uri"), head["warc-type"], refers and refers[1:-1], n_bytes, digest),
            payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: len(rows[0])])


def _parse(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        for batch in batches:
            for name, _, at, packed, size in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_file(f"{path}/{name}") as source:
                    contents = _open_frame(source, at, packed, size)
                rows, here = [], 0
                while here < len(contents):
                    head, block, here = parse_record(contents, here)
                    rows.append(_describe(head, block)[0])
                yield _batch(rows)
    return run


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names (columns ``RECORD``)."""
    n = partitions(spark)
    bundles = index.select("bundle").distinct().repartition(n)
    frames = bundles.mapInArrow(_frames(folder), "bundle string, frame int, at long, packed long, size long")
    return frames.repartition(n, "bundle", "frame").mapInArrow(_parse(folder), RECORD)


def _pick(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        here, contents, name, source, table = None, b"", None, None, []
        for batch in batches:
            for bundle, frame, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != name:
                    name, source = bundle, files.open_input_file(f"{path}/{bundle}")
                    table = seek_table(source)
                if (bundle, frame) != here:
                    here, contents = (bundle, frame), _open_frame(source, *table[frame])
                head, block, _ = parse_record(contents[at: at + length], 0)
                row, payload = _describe(head, block)
                yield _batch([(*row, payload if row[3] == "response" else None)])
    return run


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``, with their payload (null for a revisit)."""
    found = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    ordered = (found.repartition(partitions(index.sparkSession), "bundle", "frame")
                    .sortWithinPartitions("bundle", "frame", "at").select("bundle", "frame", "at", "length"))
    return ordered.mapInArrow(_pick(folder), RECORD + ", payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to new bundles and read them back:
    ``id_col, payload_bytes, payload_digest, record_type, refers_to`` per row."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "op11-bundles")
    index = write_archives(pages, folder, id_col=id_col, **options)
    kind = dict(pages.dtypes)[id_col]
    of = F.regexp_extract("refers_to", r"^urn:page:(.*):\d+$", 1)
    return read_archives(spark, folder, index).select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.when(of != "", of).cast(kind).alias("refers_to"))
