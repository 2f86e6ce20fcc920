"""Alignment of the tokens of two tokenizers, with corpus-wide link counts from inverted pair bitmaps.

Both tokenizers cut the bytes of one space and the text. A token of A and a token of B are linked where
their bytes overlap; places where tokens of both end cut the text into groups.

Tasks number their rows and gather, for each pair of linked ids, the documents that hold it, in
containers of ``CONTAINER`` rows. A container holds a bitmap per bit of the multiplicity (how often the
pair is linked in the document): as a list of row numbers where few bits are set, as a bitmap otherwise.
Containers don't share rows, so the OR over a pair's containers has the popcount of their sum, and a
pair's documents are the OR of its planes; its links are the planes' popcounts, each times its power of
two. Counts per pair, and the highest count of each A id, are aggregates over the containers' popcounts.
Scores return the way the postings came: a container, with its pair's count joined to it, gives every
document in it the count times its multiplicity.

Tokens of a text are those of its chunks (white space and what follows it); the constructor of
``Aligner`` reads from the vocabulary of B which white space may join a piece before it, and such chunks
stay together. Chunks recur, so their alignment is kept by each worker, for up to ``KNOWN`` chunks.

Defined cases: a null or empty text, and one whose tokens don't spell its bytes, has no tokens: zeros and
an empty digest. Repeated rows are documents of their own. Texts of any length are aligned whole, in
runs of chunks. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import keep
from maskloom.llm.text import _CHUNK, _SHOWN, _WS, _worker_cache, slices

CONTAINER = 1 << 13         # rows of a container; at most 16 bits
KNOWN = 300_000             # chunks whose alignment a worker keeps
FLUSH_LINKS = 4_000_000     # links of a container that are held before they are sorted into pairs
RUN = 100_000               # chunks of one text that are aligned together
SLICE_BYTES = 2 << 20       # text encoded at once

MARKS = ".,;:!?"           # marks that may be chunks of their own behind a word

LINKED = ("kind byte, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "a int, b int, container long, planes binary, docs long, links long")


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        shown = {c: b for b, c in _SHOWN.items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode()
                        for t in (self.a.id_to_token(i) or "" for i in range(size))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b, joined, behind = [], set(), set()
        white = re.compile(f"[^{_WS}]([{_WS}])").findall
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:-1], 16)]))
            else:
                plain = piece.replace("▁", " ")
                self.bytes_b.append(plain.encode())
                if not self.b.is_control(i) and not self.b.is_unknown(i):
                    joined.update(white(plain))
                    behind.update(re.findall(r"[^\W\d_]([^\w\s])", plain))
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.joined = "".join(sorted(joined))
        # Marks that no piece of B holds behind a letter; A's pattern cuts there as well.
        self.apart = re.compile(f"([{_WS}]*[^\\W\\d_]+)([{''.join(re.escape(c) for c in MARKS if c not in behind)}]+)").fullmatch
        # Chunks are encoded after a letter, as inside a text; its own piece comes first and is taken off.
        self.anchor = self.b.encode("x")
        self.wide = len(self.bytes_a) * len(self.bytes_b) >= 2**32
        self.kept: dict[str, tuple[bytes | None, bytes, int]] = {}

    @staticmethod
    def of(path_a: str, path_b: str) -> "Aligner":
        return _worker_cache(f"aligner:{path_a}:{path_b}", lambda: Aligner(path_a, path_b))

    def chunks(self, text: str) -> list[str]:
        """Chunks of one space and ``text``; a chunk that B may join to the one before is part of it.

        A word and the marks behind it are chunks of their own where neither tokenizer joins them.
        """
        found = _CHUNK.findall(" " + text)
        if self.joined and any(c in text for c in self.joined):
            out: list[str] = []
            for c in found:
                if out and c[0] in self.joined:
                    out[-1] += c
                else:
                    out.append(c)
            return out
        out = []
        for c in found:
            if c[-1] in MARKS and (parts := self.apart(c)):
                out += parts.groups()
            else:
                out.append(c)
        return out

    def learn(self, wanted) -> None:
        """Align the chunks that are not known yet; forget the others when there are too many."""
        todo = [c for c in wanted if c not in self.kept]
        if len(self.kept) + len(todo) > KNOWN and self.kept:
            self.kept.clear()
            todo = list(wanted)
        for i in range(0, len(todo), 20_000):
            self._align(todo[i:i + 20_000])

    def _align(self, chunks: list[str]) -> None:
        """Keep, for each chunk, the text of its groups (None: tokens don't spell it), the pairs of its
        links, and its numbers of A tokens, B tokens and groups, 32 bits each."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        skip, anchor = len(self.anchor), self.anchor
        ids_b = [ids[skip:] if ids[:skip] == anchor else [] for ids in self.b.encode(["x" + c for c in chunks], num_threads=1)]
        raw = [c.encode() for c in chunks]
        bad = [i for i, (r, a, b) in enumerate(zip(raw, ids_a, ids_b)) if b"".join([self.bytes_a[x] for x in a]) != r
               or b"".join([self.bytes_b[x] for x in b]) != r] if not self._all_spelled(raw, ids_a, ids_b) else []
        if bad:
            for i in bad:
                self.kept[chunks[i]] = (None, b"", 0)
            gone = set(bad)
            chunks, raw, ids_a, ids_b = ([x for i, x in enumerate(y) if i not in gone] for y in (chunks, raw, ids_a, ids_b))
        if not chunks:
            return
        ends = np.cumsum(np.array([len(r) for r in raw], np.int64))
        all_a, all_b = (np.array([*chain.from_iterable(ids)], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[all_a]), np.cumsum(self.size_b[all_b])
        # Every stretch between two ends of tokens, of A or of B, is the overlap of one token of each.
        is_end = np.zeros(int(ends[-1]) + 1, np.int8)
        is_end[end_a] = 1
        is_end[end_b] += 2
        cuts = np.flatnonzero(is_end)
        pairs = self.key(all_a[np.searchsorted(end_a, cuts)], all_b[np.searchsorted(end_b, cuts)]).tobytes()
        shared = np.flatnonzero(is_end == 3)
        upto = [np.searchsorted(x, ends, "right").tolist() for x in (end_a, end_b, cuts, shared)]
        group_a, group_b = np.searchsorted(end_a, shared, "right").tolist(), np.searchsorted(end_b, shared, "right").tolist()
        text_a, text_b = [*map(str, all_a.tolist())], [*map(str, all_b.tolist())]
        groups, i, j = [], 0, 0
        for x, y in zip(group_a, group_b):
            if x - i == 1 and y - j == 1:
                groups.append(text_a[i] + "|" + text_b[j])
            else:
                groups.append(",".join(text_a[i:x]) + "|" + ",".join(text_b[j:y]))
            i, j = x, y
        kept, width = self.kept, 8 if self.wide else 4
        a = b = c = g = 0
        for chunk, a1, b1, c1, g1 in zip(chunks, *upto):
            kept[chunk] = (";".join(groups[g:g1]).encode(), pairs[width * c:width * c1], a1 - a | b1 - b << 32 | g1 - g << 64)
            a, b, c, g = a1, b1, c1, g1

    def _all_spelled(self, raw, ids_a, ids_b) -> bool:
        whole, sizes = b"".join(raw), np.array([len(r) for r in raw], np.int64)
        for ids, names, lengths in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            flat = [*chain.from_iterable(ids)]
            run = np.concatenate(([0], np.cumsum(lengths[flat]))) if flat else np.zeros(1, np.int64)
            ends = np.cumsum([len(x) for x in ids])
            if not (run[ends] == np.cumsum(sizes)).all() or b"".join([names[x] for x in flat]) != whole:
                return False
        return True

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Linked ids as one number."""
        return (a * len(self.bytes_b) + b).astype(np.int64 if self.wide else np.uint32)

    def align(self, texts: list[str | None]):
        """For each text ``(n_a, n_b, n_groups, digest, pairs)``; pairs are the keys of all its links."""
        out: list = [None] * len(texts)
        few: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            self.learn(dict.fromkeys(chain.from_iterable(run for _, run in few)))
            for i, run in few:
                out[i] = self._joined([run])
            few.clear()
            held = 0

        for i, text in enumerate(texts):
            if not text:
                out[i] = NOTHING
                continue
            run = self.chunks(text)
            if len(run) > RUN:
                flush()
                out[i] = self._joined((run[j:j + RUN] for j in range(0, len(run), RUN)), learn=True)
                continue
            few.append((i, run))
            held += len(run)
            if held > RUN:
                flush()
        flush()
        return out

    def _joined(self, runs, learn: bool = False):
        digest, first, pairs, counts = hashlib.sha256(), True, [], 0
        for run in runs:
            if learn:
                self.learn(dict.fromkeys(run))
            texts, links, numbers = zip(*map(self.kept.__getitem__, run))
            if None in texts:
                return NOTHING
            digest.update(b";".join(texts) if first else b";" + b";".join(texts))
            first = False
            counts += sum(numbers)
            pairs.append(b"".join(links))
        low = 0xFFFFFFFF
        return counts & low, counts >> 32 & low, counts >> 64, digest.hexdigest(), np.frombuffer(b"".join(pairs), np.int64 if self.wide else np.uint32)


NOTHING = (0, 0, 0, "", np.zeros(0, np.int64))


def pack_rows(rows: np.ndarray) -> bytes:
    """Sorted rows of a container: a mark of one byte, then a list of 16-bit rows or a bitmap."""
    if 16 * len(rows) <= CONTAINER:
        return b"\0" + rows.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, bool)
    bits[rows] = True
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack_rows(data) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def pack_planes(rows: np.ndarray, times: np.ndarray) -> bytes:
    """Rows and their multiplicities as planes; each has its bit, its length and its packed rows."""
    if times.max() == 1:
        body = pack_rows(rows)
        return b"\0" + len(body).to_bytes(4, "little") + body
    out = []
    for bit in range(int(times.max()).bit_length()):
        of = rows[times >> bit & 1 == 1]
        if len(of):
            body = pack_rows(of)
            out.append(bytes([bit]) + len(body).to_bytes(4, "little") + body)
    return b"".join(out)


def unpack_planes(data: bytes):
    """``(bit, rows)`` of every plane."""
    at = 0
    while at < len(data):
        end = at + 5 + int.from_bytes(data[at + 1:at + 5], "little")
        yield data[at], unpack_rows(data[at + 5:end])
        at = end


class _Container:
    """Links of the rows of one container: sorted into pairs and rows when many are held."""

    def __init__(self):
        self.rows, self.pairs, self.held = [], [], 0
        self.sorted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: int, pairs: np.ndarray) -> None:
        if len(pairs):
            self.rows.append((row, len(pairs)))
            self.pairs.append(pairs)
            self.held += len(pairs)
            if self.held >= FLUSH_LINKS:
                self._sort()

    def _sort(self) -> None:
        if not self.pairs:
            return
        row, n = (np.array(x, np.int64) for x in zip(*self.rows))
        both = np.concatenate(self.pairs).astype(np.int64) * CONTAINER + np.repeat(row, n)
        both.sort()
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        times = np.diff(np.append(first, len(both)))
        pair, row = np.divmod(both[first], CONTAINER)
        self.sorted.append((pair, row.astype(np.uint16), times.astype(np.uint32)))
        self.rows, self.pairs, self.held = [], [], 0

    def postings(self):
        """``pair, planes, documents, links`` of every pair; parts that hold the same pair are merged."""
        self._sort()
        if not self.sorted:
            return
        pair, row, times = (np.concatenate(x) for x in zip(*self.sorted))
        if len(self.sorted) > 1:  # parts hold different rows, in ascending order
            order = np.argsort(pair, kind="stable")
            pair, row, times = pair[order], row[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        links = np.add.reduceat(times.astype(np.int64), first)
        bounds = np.append(first, len(pair))
        docs = np.diff(bounds)
        single = np.maximum.reduceat(times, first) == 1
        small = single & (16 * docs <= CONTAINER)
        # Most postings are one plane with a short list of rows; these are cut out of one buffer.
        raw = row.astype("<u2").tobytes()
        heads = {}
        for k, (i, j, few) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), small.tolist())):
            if few:
                n = j - i
                if n not in heads:
                    heads[n] = b"\0" + (1 + 2 * n).to_bytes(4, "little") + b"\0"
                planes = heads[n] + raw[2 * i:2 * j]
            else:
                planes = pack_planes(row[i:j].astype(np.int64), times[i:j].astype(np.int64))
            yield int(pair[i]), planes, int(docs[k]), int(links[k])


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"kind": pa.int8(), "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "planes": pa.binary()}
    arrays, names = [], []
    for field in LINKED.split(", "):
        name = field.split()[0]
        arrays.append(pa.array(columns[name], types.get(name, pa.int64())) if name in columns else pa.nulls(n, types.get(name, pa.int64())))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def link(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds: 0, a document with its numbers; 1, a pair's postings in one container."""
    def run(batches):
        aligner = Aligner.of(path_a, path_b)
        base, count = TaskContext.get().partitionId() << 33, 0
        container = _Container()

        def close():
            number, some = (base + count - 1) // CONTAINER, []
            for x in container.postings():
                some.append(x)
                if len(some) == 20_000:
                    yield postings(number, some)
                    some = []
            if some:
                yield postings(number, some)

        def postings(number, some):
            pair, planes, n, links = zip(*some)
            a, b = np.divmod(np.array(pair, np.int64), len(aligner.bytes_b))
            return _batch(kind=np.ones(len(some), np.int8), a=a, b=b, container=np.full(len(some), number),
                          planes=planes, docs=n, links=links)

        for some in slices(batches, "text", SLICE_BYTES):
            ids, found = some.column("doc_id").to_pylist(), aligner.align(some.column("text").to_pylist())
            rows = []
            for doc, (n_a, n_b, n_groups, digest, pairs) in zip(ids, found):
                container.add(count % CONTAINER, pairs)
                rows.append((base + count, doc, n_a, n_b, n_groups, len(pairs), digest))
                count += 1
                if count % CONTAINER == 0:
                    yield from close()
                    container = _Container()
            names = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            yield _batch(kind=np.zeros(len(rows), np.int8), **dict(zip(names, zip(*rows))))
        if count % CONTAINER:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a, b, docs, links, best``: documents and links of each pair; is its count the highest of its A id?"""
    counts = keep(linked.filter("kind = 1").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "pairs")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("top")).alias("best"))


def returned(postings: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` from ``container, planes, count, best``: summed per container in a task."""
    def run(batches):
        number, count_sum, n_best = None, None, None

        def close():
            rows = np.flatnonzero(count_sum)
            return pa.RecordBatch.from_arrays([pa.array(number * CONTAINER + rows), pa.array(n_best[rows]), pa.array(count_sum[rows])],
                                              ["row", "n_best", "count_sum"])

        for batch in batches:
            columns = [batch.column(c) for c in ("container", "planes", "count", "best")]
            for c, planes, count, best in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3].to_pylist()):
                if c != number:
                    if number is not None:
                        yield close()
                    number, count_sum, n_best = c, np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
                for bit, rows in unpack_planes(planes):
                    count_sum[rows] += count << bit
                    if best:
                        n_best[rows] += 1 << bit
        if number is not None:
            yield close()

    return postings.select("container", "planes", "count", "best").mapInArrow(run, "row long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    linked = keep(link(docs, path_a, path_b), "linked")
    scored = keep(pair_counts(linked), "scored").select("a", "b", F.col("docs").alias("count"), "best")
    small = scored.count() <= 2_000_000  # rows of 17 bytes
    postings = linked.filter("kind = 1").select("a", "b", "container", "planes")
    if small:
        joined = postings.join(F.broadcast(scored), ["a", "b"])  # containers stay as they were written
    else:
        joined = postings.join(scored, ["a", "b"]).repartition("container").sortWithinPartitions("container")
    sums = returned(joined).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    digests = linked.filter("kind = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return digests.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
