"""Token ids in files of length-delimited binary records, with an offset index.

A record is: 8 bytes length of the data, 4 bytes masked checksum of those 8 bytes, the data, 4 bytes
masked checksum of the data; integers are little-endian. The checksum is CRC-32, masked as public
record formats do (rotated right by 15 bits, plus a constant), so that checksums stored inside data
do not match by accident. The data is: 8 bytes document id, 1 byte flag (1: the id is null), then the
token ids, 2 bytes each if every id of the vocabulary fits, else 4.

Files follow each other in ascending order of documents, and so do records in a file. The index has
one row per record (file, byte offset, length, number of tokens); shuffled reads go through it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.llm.store import filesystem, hinted, keep, put
from maskloom.llm.text import ChunkEncoder, slices

MASK = 0xA282EAD8  # fixed value: the constant that masked checksums add
RANGE_BYTES = 8 << 20       # bytes of a file that are read at once
TASK_BYTES = 16 << 20       # bytes of texts or records for which a task is planned
INDEX = "file string, record long, offset long, length long, doc_id long, n_tokens long"


def tasks_for(volume: int) -> int:
    return max(1, -(-volume // TASK_BYTES))


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def unframe(buffer, at: int) -> tuple[bytes, int]:
    """Data of the record at ``at`` and the place after it; both checksums are verified."""
    head = bytes(buffer[at:at + 8])
    length = struct.unpack("<Q", head)[0]
    data = bytes(buffer[at + 12:at + 12 + length])
    sums = struct.unpack("<I", buffer[at + 8:at + 12]) + struct.unpack("<I", buffer[at + 12 + length:at + 16 + length])
    if sums != (masked(head), masked(data)):
        raise ValueError(f"checksum mismatch in the record at {at}")
    return data, at + 16 + length


def _data(doc: int | None, ids: bytes, width: str) -> bytes:
    return struct.pack("<qB", doc or 0, doc is None) + np.frombuffer(ids, "<u4").astype(width).tobytes()


def _ids(data: bytes, width: str) -> tuple[int | None, np.ndarray]:
    doc, null = struct.unpack_from("<qB", data)
    return (None if null else doc), np.frombuffer(data, width, offset=9)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end: int, tasks: int,
                width: str = "<u2", file_bytes: int = 128 << 20) -> DataFrame:
    """Tokenize whole texts, append ``end``, write files and the index to ``folder``; returns the index.

    Documents are dealt to tasks by ranges of ``doc_id`` and sorted inside; file names sort as their
    documents do. A file is closed once it holds ``file_bytes``.
    """
    def write(batches):
        files, root = filesystem(folder)
        encoder, task = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId()
        tail, part = np.array([end], "<u4").tobytes(), 0
        held: list[bytes] = []
        rows: list[tuple] = []
        at = 0

        def close():
            nonlocal part, held, rows, at
            name = f"tokens-{task:06d}-{part:04d}.bin"
            put(files, f"{root}/{name}", lambda stream: [stream.write(x) for x in held])
            cols = list(zip(*rows))
            out = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), *[pa.array(c, pa.int64()) for c in cols]],
                ["file", "record", "offset", "length", "doc_id", "n_tokens"])
            part, held, rows, at = part + 1, [], [], 0
            return out

        for some in slices(batches, "text"):
            for doc, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                record = frame(_data(doc, ids + tail, width))
                rows.append((len(rows), at, len(record), doc, len(ids) // 4 + 1))
                held.append(record)
                at += len(record)
            if at >= file_bytes:
                yield close()
        if rows:
            yield close()

    dealt = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_files(spark: SparkSession, folder: str, width: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Every record read back: ``file, record, doc_id, n_tokens, ids_crc32`` (and ``ids``).

    The index cuts files into ranges of about ``RANGE_BYTES``; a task reads some of them.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    schema = "file string, record long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    ranges = index.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES)).agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("record").alias("record"))

    def read(batches):
        files, root = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_file(f"{root}/{r['file']}") as stream:
                    stream.seek(r["first"])
                    buffer = memoryview(stream.read(r["end"] - r["first"]))
                at, out = 0, []
                while at < len(buffer):
                    data, at = unframe(buffer, at)
                    doc, ids = _ids(data, width)
                    out.append((r["file"], r["record"] + len(out), doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                for i in range(0, len(out), 2000):
                    cols = list(zip(*out[i:i + 2000]))
                    arrays = [pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:5]]]
                    names_ = ["file", "record", "doc_id", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                        names_.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names_)

    volume = index.agg(F.sum("length")).first()[0] or 0
    return ranges.repartition(tasks_for(volume)).mapInArrow(read, schema)


def shuffled(spark: SparkSession, folder: str, seed: int, tasks: int, width: str = "<u2") -> DataFrame:
    """``doc_id, ids`` in an order drawn from ``seed``: index rows are shuffled, then read by offset."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")

    def read(batches):
        files, root = filesystem(folder)
        opened: dict = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if len(opened) > 64 and r["file"] not in opened:
                    opened.pop(next(iter(opened))).close()
                stream = opened.setdefault(r["file"], None) or files.open_input_file(f"{root}/{r['file']}")
                opened[r["file"]] = stream
                stream.seek(r["offset"])
                doc, ids = _ids(unframe(stream.read(r["length"]), 0)[0], width)
                out.append((doc, ids.astype(np.int32)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32()))],
                                                 ["doc_id", "ids"])

    draw = F.xxhash64(F.lit(seed), "file", "record")
    return index.withColumn("_draw", draw).repartitionByRange(tasks, "_draw").sortWithinPartitions("_draw").drop(
        "_draw").mapInArrow(read, "doc_id long, ids array<int>")


def positions(records: DataFrame) -> DataFrame:
    """Add ``start``: the number of ids in all records before.

    A window runs inside each file; the files' totals, a row each, are summed up over all files.
    ``records`` is used twice, so it should be written.
    """
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("record")) - F.col("n_tokens")
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("_before"))
    return records.withColumn("start", inside).join(hinted(before), "file").withColumn(
        "start", F.col("start") + F.col("_before")).drop("_before")


def round_trip(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, tasks: int | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` and read the files back: ``doc_id, start, n_tokens, ids_crc32``.

    Null or empty texts are the end id alone. Rows with a null id come first; repeated ids follow
    each other, by text. An empty table writes an empty index. Only ``doc_id, text`` are read.
    """
    spark = docs.sparkSession
    if not tasks:
        tasks = tasks_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    write_files(docs, folder, tokenizer, end, tasks)
    return positions(keep(read_files(spark, folder), "records")).select("doc_id", "start", "n_tokens", "ids_crc32")
