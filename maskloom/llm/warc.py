"""WARC archives in seekable Zstandard bundles.

A task writes its pages, in order of ``page_id``, to bundle files. Records are grouped into
independent frames of about ``frame_bytes``; a skippable frame at the end holds the seek table of
the public seekable format (frame count and sizes). The index maps a record identifier to bundle,
frame and the record's offset inside the frame, so one record costs one frame. Equal payloads are
stored once: the page with the largest id holds the response, the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.store import filesystem, hinted, keep, put

# Fixed values of the file formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # of every record, so that a repeated task writes equal bytes
URN = "urn:x-page:"

TASK_BYTES = 8 << 20        # plain bytes of records for which a task is planned
INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")


def tasks_for(volume: int, most: int | None = None) -> int:
    n = max(1, -(-volume // TASK_BYTES))
    return n if most is None else min(n, max(1, most))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = "none" if page is None else page
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class _Bundle:
    """One bundle file, written to a part file that is renamed when whole."""

    def __init__(self, level: int, frame_bytes: int):
        self.coder, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.done: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.size = 0
        self.index: list[tuple] = []

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.coder.compress(b"".join(self.open))
            self.frames.append((len(packed), self.held))
            self.done.append(packed)
            self.size += len(packed)
            self.open, self.held = [], 0

    def write(self, stream) -> None:
        for part in self.done:
            stream.write(part)
        stream.write(_seek_table(self.frames))


def write_archives(pages: DataFrame, folder: str, tasks: int, frame_bytes: int = 256 << 10,
                   bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write bundles of ``page_id, url, html, refers_to`` rows to ``folder``; returns the index.

    A null ``html`` is an empty payload. A bundle is held in memory until it is whole, at most
    ``bundle_bytes`` compressed and one frame. The index is a Parquet table in the same folder.
    """
    def bundles(batches):
        files, root = filesystem(folder)
        task, count, bundle = TaskContext.get().partitionId(), 0, None

        def close():
            nonlocal count, bundle
            bundle.end_frame()
            name = f"bundle-{task:06d}-{count:04d}.warc.zst"
            put(files, f"{root}/{name}", bundle.write)
            ids, frame, offset, length = zip(*bundle.index)
            count, bundle = count + 1, None
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([name] * len(ids)), pa.array(frame, pa.int32()),
                 pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                ["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                bundle = bundle or _Bundle(level, frame_bytes)
                page = page.as_py()
                record = _record(page, url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                bundle.add(f"{URN}{'none' if page is None else page}", record)
                if bundle.size >= bundle_bytes:
                    yield close()
        if bundle:
            yield close()

    rows = pages.select("page_id", "url", "html", "refers_to").repartition(tasks, "page_id").sortWithinPartitions("page_id", "url", "html")
    rows.mapInArrow(bundles, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame, from the end of a bundle."""
    stream.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    stream.seek(size - 9 - 8 * frames)
    body, at, out = stream.read(8 * frames), 0, []
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", body, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def parse(frame: bytes, at: int = 0, most: int | None = None):
    """Fields of the records of a decompressed frame, from offset ``at`` on."""
    got = 0
    while at < len(frame) and (most is None or got < most):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
        block = frame[end + 4:end + 4 + int(head["Content-Length"])]
        if frame[end + 4 + len(block):end + 8 + len(block)] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        named = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != named):
            raise ValueError("a payload does not match its digest")
        page, refers = (re.sub(rf"[<>]|{URN}", "", head.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
        url = head.get("WARC-Target-URI")
        yield (None if page == "none" else int(page),
               None if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
               length, named, head["WARC-Type"], int(refers) if refers else None,
               payload if head["WARC-Type"] == "response" else None)
        at, got = end + 8 + len(block), got + 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles in ``folder``, frame by frame through their seek tables."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")

    def read(batches):
        files, root = filesystem(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                path = f"{root}/{name}"
                with files.open_input_file(path) as stream:
                    for at, packed, plain in seek_table(stream, stream.size()):
                        stream.seek(at)
                        frame = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain)
                        rows = list(parse(frame))
                        yield _batch(rows if payloads else [(*r[:-1], None) for r in rows])

    bundles, volume = index.agg(F.count_distinct("bundle"), F.sum("length")).first()
    # Names are dealt out one by one: their bytes say nothing about the bundles'.
    return index.select("bundle").distinct().repartition(tasks_for(volume or 0, bundles)).mapInArrow(read, RECORDS)


def fetch(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """The records named in ``ids`` (``record_id``): one frame is read for each group of records."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    wanted = index.join(ids.select("record_id").distinct(), "record_id")

    def read(batches):
        files, root = filesystem(folder)
        last, frame, table, stream = None, b"", [], None
        for batch in batches:
            for row in batch.to_pylist():
                if last is None or last[0] != row["bundle"]:
                    stream = files.open_input_file(f"{root}/{row['bundle']}")
                    table = seek_table(stream, stream.size())
                if last != (row["bundle"], row["frame"]):
                    last = (row["bundle"], row["frame"])
                    at, packed, plain = table[row["frame"]]
                    stream.seek(at)
                    frame = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain)
                yield _batch(list(parse(frame, row["offset"], 1)))

    bundles, volume = wanted.agg(F.count_distinct("bundle"), F.sum("length")).first()
    dealt = wanted.repartition(tasks_for(volume or 0, bundles), "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(read, RECORDS)


def with_referents(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: the page that holds an equal payload, null if it is this one.

    Payloads are compared by SHA-1 and length, and only from ``least_bytes`` on. The page with the
    largest id holds the payload; rows with a null id hold their own. Digests are grouped before any
    page is moved, so copies of one payload do not meet in a task.
    """
    plain = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(plain.cast("binary")).alias("sha"),
                        F.octet_length(plain).alias("size"))
    sized = keep(rows.select("page_id", "sha", "size").filter(
        (F.col("size") >= least_bytes) & F.col("page_id").isNotNull()), "digests")
    held = keep(sized.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                .filter("n > 1").drop("n"), "held")
    again = keep(sized.join(hinted(held), ["sha", "size"]).filter("page_id <> refers_to").distinct(), "revisits")
    return rows.join(hinted(again), ["page_id", "sha", "size"], "left").drop("sha", "size")


def archive(pages: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: one record per row, with its payload.

    Null html is an empty payload, a null url leaves the record without a target, a row with a null
    id is a response nothing refers to. Repeated rows give repeated records. An empty table writes
    an empty index. Columns other than ``page_id, url, html`` are left out.
    """
    spark = pages.sparkSession
    tasks = tasks or tasks_for(pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0)
    write_archives(with_referents(pages), folder, tasks)
    return read_archives(spark, folder)
