"""Packing of tokenized documents into sequences of fixed length, with swap-based local search.

Only documents longer than a sequence are cut. Pieces are dealt to shards by hash, each of a bounded
number of pieces whatever the input; a shard is packed in one task. The start is best fit over
decreasing lengths. Then the emptiest sequences give up pieces to fuller ones by moves,
two-for-one and one-for-one exchanges; each step raises the sum of squared fills, and a sequence
that runs empty is gone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import keep
from maskloom.llm.text import ChunkEncoder, slices

CAPACITY = 2048
SHARD = 16_384  # pieces packed together
END = 0

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END,
                  with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): token ids and the end id, cut to
    ``capacity``. ``tokenizer`` is the path of a vocabulary file that every executor has."""

    def cut(batches):
        encoder = ChunkEncoder.of(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        for rows in slices(batches, "text"):
            out = []
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(rows.column("text").to_pylist())):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*out))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + (", ids binary" if with_ids else ""))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit f is set when a bin has f free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fit = mask >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        if free > s:
            room[free - s].append(b)
            mask |= 1 << (free - s)
    return bins


def _exchange(gives: list[int], takes: list[int], room: int, at_least: int, sizes: list[int]):
    """Pieces to pass from the emptier to the fuller bin and back, for the largest gain up to ``room``.

    Tried in order: a move, two for one, one for one. ``at_least`` is the smallest gain that raises
    the sum of squares.
    """
    best, how = at_least - 1, None
    for i in gives:
        if best < sizes[i] <= room:
            best, how = sizes[i], ([i], [])
    if best == room or not takes:
        return how
    back = sorted(takes, key=lambda j: sizes[j])
    lengths = np.array([sizes[j] for j in back])
    pairs = [[i] for i in gives] + [[i, j] for n, i in enumerate(gives) for j in gives[n + 1:]]
    for pair in reversed(pairs):  # two for one first
        total = sum(sizes[i] for i in pair)
        k = int(np.searchsorted(lengths, total - room))  # smallest piece that leaves room
        if k < len(back) and total - lengths[k] > best:
            best, how = int(total - lengths[k]), (pair, [back[k]])
            if best == room:
                break
    return how


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, patience: int = 40,
                 widest: int = 24, receivers: int = 400) -> list[list[int]]:
    """Empty the emptiest bins into the others as far as exchanges allow.

    ``patience`` donors in a row that keep pieces end the search, as does the lower bound on bins.
    Of a donor at most ``widest`` smallest pieces enter exchanges at a time, and the ``receivers``
    bins with the most room are offered them; both bound the work, no piece is left out of the result.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(sizes) // capacity)
    left, given = sum(1 for b in bins if b), set()
    misses = 0
    while left > least and misses < patience:
        donors = [b for b in range(len(bins)) if bins[b] and fill[b] < capacity and b not in given]
        if not donors:
            break
        donor = min(donors, key=lambda b: fill[b])
        given.add(donor)
        others = sorted((b for b in range(len(bins)) if bins[b] and b != donor and fill[b] < capacity),
                        key=lambda b: fill[b])[:receivers]
        moved, changed = True, False
        while moved and bins[donor]:
            moved = False
            for b in sorted(others, key=lambda b: -fill[b]):
                while bins[donor] and fill[b] < capacity:
                    gain = max(1, fill[donor] - fill[b] + 1)
                    gives = sorted(bins[donor], key=lambda i: sizes[i])[:widest]
                    how = _exchange(gives, bins[b], capacity - fill[b], gain, sizes)
                    if how is None:
                        break
                    out, back = how
                    delta = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
                    bins[donor] = [i for i in bins[donor] if i not in out] + back
                    bins[b] = [i for i in bins[b] if i not in back] + out
                    fill[donor] -= delta
                    fill[b] += delta
                    moved = changed = True
        if changed:  # what failed before may succeed now
            given = {donor}
        misses = misses + 1 if bins[donor] else 0
        left = sum(1 for b in bins if b)
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions of ``sizes``, none over ``capacity``."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``; ``pieces`` must be written already."""
    count = pieces.filter(F.col("length") < capacity).count()
    shards = max(1, -(-count // shard))
    columns = pieces.columns
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece")])
        sizes = rows["length"].to_pylist()
        seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        base = rows["_shard"][0].as_py() << 32
        for k, members in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = base + k, at
                at += sizes[i]
        return rows.select(columns).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    part = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(shards)))
    mixed = part.filter(F.col("length") < capacity).groupBy("_shard").applyInArrow(pack, schema)
    # A full piece is a sequence of its own; its number is unique among rows that differ.
    full = part.filter(F.col("length") >= capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(full)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, shard: int = SHARD,
         with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``), one row per piece.

    A null or empty text is the end id alone. Repeated rows, and rows with a null id, are packed
    like any other. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    return pack_pieces(keep(cut_documents(docs, tokenizer, capacity, end, with_ids), "pieces"), capacity, shard)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from rows packed ``with_ids``."""
    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        return pa.table({"sequence_id": rows["sequence_id"][:1],
                         "ids": pa.array([np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u4").astype(np.int32)])})
    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        join, "sequence_id long, ids array<int>")
